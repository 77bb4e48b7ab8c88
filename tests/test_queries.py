"""Every query with an SQL equivalent gives the same rows in both engines."""

from __future__ import annotations

import forecourt.plans.page_queries  # noqa: F401 - adds its queries
import pytest
from forecourt.plans.catalogue import QUERIES, SQL
from forecourt.plans.streaming_queries import STREAMING
from oracle import compare, connect
from pyspark.sql import functions as F

ALL = QUERIES | STREAMING


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(set(ALL) & set(SQL)))
def test_same_rows(spark, data, con, name):
    assert compare(ALL[name](spark, data), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    assert ALL[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert {"make", "n"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_next_closure_of_every_page(spark, tmp_path):
    """h11_next_closure_all against a walk: a chain of over 50 pages, a cycle, a dead end, a self-link."""
    at = "https://d/inventory?page={}".format
    after = {k: k + 1 for k in range(60)} | {100: 101, 101: 102, 102: 100, 200: 201, 300: 300}
    ids = sorted({*after, *after.values()} - {201})
    html = [f'<html><body><a rel="next" href="{at(after[k])}">2</a></body></html>' if k in after else "<p>last</p>" for k in ids]
    spark.createDataFrame([(k, at(k), h) for k, h in zip(ids, html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = set()
    for start in ids:
        seen, now = [start], start
        while now in after and after[now] not in seen and len(seen) <= 50:
            now = after[now]
            seen.append(now)
            want.add((start, len(seen) - 1, at(now)))
    got = [tuple(r) for r in QUERIES["h11_next_closure_all"](spark, str(tmp_path)).collect()]
    assert max(level for _, level, _ in want) == 50 and len(got) == len(want) and set(got) == want


def test_next_closure_where_addresses_repeat(spark, tmp_path):
    """Of several captures of an address the smallest next link counts, in the SQL as well."""
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("https://d/"), F.when(F.col("id") % 50 == 49, "0").otherwise(F.col("id") % 37)).alias("url"), F.lit("").alias("html"))
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    assert compare(QUERIES["h11_next_closure"](spark, str(tmp_path)), connect(str(tmp_path)), SQL["h11_next_closure"]) is None


def test_digits_price_of_matches(spark, data):
    """Whole price texts have prices."""
    assert max(r.price for r in QUERIES["x18_digits_price_match"](spark, data).collect()) > 1000


def test_sessions_keep_their_settings(spark, data):
    """No query changes the caller's session."""
    before = dict(r[:2] for r in spark.sql("SET").collect())
    for name in ("e_run_listings", "v1_issues", "e3_run_pages"):
        ALL[name](spark, data).count()
    assert dict(r[:2] for r in spark.sql("SET").collect()) == before
