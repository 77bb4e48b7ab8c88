"""Queries that run a stream to its end, and reading back what was written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import listings as sources
from ..sources import sinks
from ..sources.shared import cleaned, discard, scratch
from ..streaming import ingest
from .catalogue import SQL, YEAR
from .views import KEYS, listings, table


def k5_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a table by a stream that reads what is there and stops."""
    home = scratch(spark)
    shape = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(shape).option("pathGlobFilter", "events*").parquet(sf_dir)
    query = ingest.append_stream(stream, f"{home}/events", f"{home}/checkpoint", lambda rows: rows.where("event_type = 'purchase'"))
    query.awaitTermination()
    return spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in shape)}, batch long").parquet(f"{home}/events").select("event_id", "user_id", "value")


def _constructible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where(f"year <= {YEAR + 1}")


def s3_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch(spark)
    sinks.write_csv(_constructible(spark, sf_dir), f"{home}/cars.csv")
    return sources.read_csv(spark, f"{home}/cars.csv", as_of_year=YEAR).select("vehicle_url", "year", "vin", "msrp", "description", "features")


def k1_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = scratch(spark)
    sinks.write_jsonl(_constructible(spark, sf_dir), f"{home}/cars.jsonl", compression="gzip")
    return sources.read_jsonl(spark, f"{home}/cars.jsonl", as_of_year=YEAR).select("vehicle_url", "year", "vin", "msrp", "description", "features")


def d1_streamed_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 over a stream of three batches, then the survivors of all of them; what the state holds goes from the input."""
    home, rows = scratch(spark), listings(spark, sf_dir)
    for part in range(3):
        with cleaned(spark):
            rows.where(f"l_orderkey % 3 = {part}").write.option("compression", "zstd").parquet(f"{home}/in/{part}")
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{home}/in")
        ingest.deduplicate_stream(stream, f"{home}/state", f"{home}/checkpoint", ["ord"]).awaitTermination()
        discard(spark, f"{home}/in/{part}")
    return ingest.deduplicated(spark, f"{home}/state", rows, ["ord"]).select(*KEYS)


STREAMING: dict[str, Callable[[SparkSession, str], DataFrame]] = {"k5_stream_append": k5_stream_append, "s3_csv_roundtrip": s3_csv_roundtrip, "k1_json_roundtrip": k1_json_roundtrip, "d1_streamed_survivors": d1_streamed_survivors}
_WITH = SQL["p01_price"].split(" SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce")[0]
SQL["d1_streamed_survivors"] = SQL["d1_dedup_survivors"]
SQL["k5_stream_append"] = "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'"
SQL["s3_csv_roundtrip"] = f"{_WITH} SELECT vehicle_url, year, nullif(vin, '') AS vin, msrp, replace(description, chr(10), ' ') AS description, features FROM listings WHERE year <= {YEAR + 1}"
SQL["k1_json_roundtrip"] = f"{_WITH} SELECT vehicle_url, year, vin, msrp, description, features FROM listings WHERE year <= {YEAR + 1}"
