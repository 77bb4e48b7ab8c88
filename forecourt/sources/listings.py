"""Reading listings from JSON, JSON lines, CSV and saved state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null, strip
from ..schema import COLUMNS, DEFAULTS, LISTING, is_constructible
from . import documents

_RAW = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, (T.ArrayType, T.IntegerType, T.DoubleType)) else T.StringType()) for f in LISTING])


def _time(text: Column) -> Column:
    """An ISO time without its zone; null if it is none."""
    return F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def _typed(rows: DataFrame) -> DataFrame:
    lists = ("features", "images")
    out = [F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c in lists else _time(F.col(c)).alias(c) if c == "scraped_at" else F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in COLUMNS]
    return rows.select(*out)


def _checked(rows: DataFrame, as_of_year: int) -> DataFrame:
    """Fail the job at the first row that is no listing."""
    ok = F.when(is_constructible(as_of_year), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a listing: "), F.to_json(F.struct("dealer_name", "vehicle_url", "year", "make", "model", "new_used"))))).cast("boolean")
    return rows.where(ok)


def read_json(spark: SparkSession, path: str, *, as_of_year: int, key: str = "cars") -> DataFrame:
    """The listings of JSON documents {metadata, cars}, split among tasks; a document without cars has none.

    Computed and unknown keys are ignored (Q1); a row that breaks the constraints fails, and
    so does a document that is no JSON.
    """
    found = documents.pieces(spark, path, key)
    rows = documents.items(found).select(F.from_json("text", _RAW).alias("car")).select("car.*")
    # No row comes of the second part: it fails or is empty. Above the minimum the error stands behind the search.
    first = documents.damaged(found).agg(F.min("document").alias("bad"))
    bad = first.select(F.when(F.col("bad").isNotNull(), F.raise_error(F.concat(F.lit("no JSON: "), "bad"))).cast("string").alias("dealer_name")).where("dealer_name IS NOT NULL")
    return _checked(_typed(rows), as_of_year).unionByName(bad, allowMissingColumns=True)


def read_jsonl(spark: SparkSession, path: str, *, as_of_year: int) -> DataFrame:
    """S1 for JSON lines: one listing a line, split among tasks."""
    return _checked(_typed(spark.read.schema(_RAW).json(path)), as_of_year)


def read_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(listings, completed dealers (name)) of saved state documents, split among tasks.

    An unreadable document is no state at all, not half of one (Q17).
    """
    found = documents.pieces(spark, path, "scraped_listings")
    bad = documents.damaged(found)
    rows = documents.items(found).join(bad, "document", "left_anti").select(F.from_json("text", _RAW).alias("car")).select("car.*")
    around = documents.surroundings(found).join(bad, "document", "left_anti").select(F.from_json("text", "completed_dealerships array<string>").alias("state"))
    return _typed(rows), around.select(F.explode("state.completed_dealerships").alias("name"))


def read_csv(spark: SparkSession, path: str, *, as_of_year: int, now: str = "1970-01-01 00:00:00") -> DataFrame:
    """S3: listings from CSV with a header.

    Empty optional cells are null, lists are split at semicolons; an empty year is
    ``as_of_year``, an empty or malformed time is ``now``. A malformed number fails the
    job; a row that breaks the constraints is skipped. Columns are found by their names.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    out = []
    for field in LISTING:
        present = field.name in raw.columns
        cell = F.coalesce(F.col(f"`{field.name}`"), F.lit("")) if present else F.lit(DEFAULTS.get(field.name, ""))
        kind = field.dataType
        if isinstance(kind, T.ArrayType):
            value = F.filter(F.transform(F.split(cell, ";"), strip), lambda x: x != "")
        elif field.name == "year":
            value = F.coalesce(blank_to_null(cell).cast("int"), F.lit(as_of_year))
        elif isinstance(kind, T.TimestampNTZType):
            value = F.coalesce(_time(blank_to_null(cell)), F.lit(now).cast("timestamp_ntz"))
        elif isinstance(kind, (T.IntegerType, T.DoubleType)):
            value = blank_to_null(cell).cast(kind)
        else:
            value = cell if field.name in ("dealer_name", "dealer_website", "vehicle_url", "make", "model", *DEFAULTS) else blank_to_null(cell)
        out.append(value.alias(field.name))
    return raw.select(*out).where(is_constructible(as_of_year))
