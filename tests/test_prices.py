"""X22 without a tree: the native prices of a text against the walk over its matches."""

from __future__ import annotations

import random

from forecourt.functions.dom import price_triple
from forecourt.functions.extract import text_prices
from forecourt.sources.dealers import find_dealers
from pyspark.sql import functions as F

WORDS = ["MSRP", "our price", "Special", "final", "OTD", "x" * 48, "y" * 50, "z" * 51, "é" * 49, " ", "", "Retail\n", "sale", "e-Price", "$", "lorem ipsum dolor sit amet " * 4]
AMOUNTS = ["$1", "$45,123", "$ 41,000", "$0", "$12.50", "$1,2", "$999999", "$5$6", "$7,000,000", "$\t8"]


def test_prices_against_a_walk(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(WORDS if r.random() < 0.6 else AMOUNTS) for _ in range(r.choice([1, 3, 8, 30, 200]))) for _ in range(600)] + [""]
    got = {row.text: tuple(row.p) for row in spark.createDataFrame([(t,) for t in texts], "text string").select("text", text_prices(F.col("text")).alias("p")).collect()}
    for text in texts:
        assert got[text] == price_triple(text), repr(text[:300])
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(text_prices(F.col("t")).alias("p")).first().p in (None, (None, None, None))


def test_dealer_file_is_looked_for(spark, tmp_path):
    (tmp_path / "b.csv").write_text("id")
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    assert find_dealers(spark, a, b) == b and find_dealers(spark, b, a) == b
    assert find_dealers(spark, a, usual=("none.csv", "other.csv")) == "none.csv"
