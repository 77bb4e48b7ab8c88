"""Incremental ingestion (K5, K6, C1-C3) and streaming deduplication with Structured Streaming.

State is a pair of tables, listings and completed dealers, in one versioned state: a batch of
both counts from one version on. The stream's own checkpoint says which input has been read;
a batch that is written again replaces itself, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dedup
from ..operators.dedup import vin_key
from ..schema import LISTING
from ..sources import sinks
from ..sources.shared import stored
from .state import State


def _publish(spark: SparkSession, staging: str, target: str) -> None:
    """Put a written folder in the place of what stands there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(path(target), True)
    if not system.rename(path(staging), path(target)):
        raise OSError(f"could not publish {target}")


def append_stream(source: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True, format: str = "parquet", timestamp: str = "1970-01-01T00:00:00") -> StreamingQuery:
    """K5: append a stream of rows to an output: Parquet as they are, or listings as csv, json or jsonl.

    Each batch is a folder named by its number. It is written out of sight and takes its place
    by a rename, so a batch that runs again after a failure replaces itself, in any format.
    """
    if format not in ("parquet", "csv", "json", "jsonl"):
        raise ValueError(f"unknown format {format!r}")

    def write(rows: DataFrame, batch: int) -> None:
        rows = transform(rows) if transform else rows
        staging = f"{path}/_batch-{batch}-{uuid.uuid4().hex}"
        if format == "parquet":
            rows.write.parquet(staging)
        else:
            sinks.save(rows, staging, format, timestamp)
        _publish(rows.sparkSession, staging, f"{path}/batch={batch}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_pages(pages: DataFrame, state: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], mark_failed: bool = True) -> StreamingQuery:
    """Extract listings of arriving pages (dealer_name among the columns) and mark their dealers done.

    Dealers without a single listing are marked as well if ``mark_failed``, so they are not
    tried again; otherwise only those with listings are.
    """

    def write(rows: DataFrame, batch: int) -> None:
        held = rows.persist()
        try:
            listings = extract(held) if mark_failed else stored(extract(held))
            done = held if mark_failed else listings
            State(rows.sparkSession, state).add(batch, {"listings": listings, "done": done.select(F.col("dealer_name").alias("name")).distinct()})
        finally:
            held.unpersist()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completed(spark: SparkSession, state: str) -> DataFrame:
    return State(spark, state).read("done", "name string").distinct()


def gathered(spark: SparkSession, state: str) -> DataFrame:
    """The listings so far."""
    return State(spark, state).read("listings", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTING))


def clear(spark: SparkSession, state: str) -> None:
    """Forget everything gathered so far."""
    State(spark, state).clear()


def deduplicate_stream(listings: DataFrame, state: str, checkpoint: str, order: Sequence[str], prefer_latest: bool = True, available_now: bool = True) -> StreamingQuery:
    """D1 over a stream: each batch adds its rows and what they say about every VIN and address.

    A later row replaces an earlier one, or comes too late to do so, however far apart they
    are: the minima of all batches are combined when ``deduplicated`` reads them. Rows and
    minima of a batch count from one version of the state on.
    """

    def write(rows: DataFrame, batch: int) -> None:
        by_vin, by_url = dedup.choices(rows, order, prefer_latest)
        State(rows.sparkSession, state).add(batch, {"rows": rows, "vins": by_vin, "urls": by_url})

    writer = listings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def deduplicated(spark: SparkSession, state: str, like: DataFrame, order: Sequence[str], prefer_latest: bool = True) -> DataFrame:
    """The survivors of D1 among all rows so far; ``like`` has the columns of the stream."""
    held = State(spark, state)
    by_vin, by_url = (part.schema for part in dedup.choices(like, order, prefer_latest))
    return dedup.deduplicate_parts(held.read("rows", like.schema), held.read("vins", by_vin), held.read("urls", by_url), order, prefer_latest)


def recent_only(listings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows of a stream whose VIN (or, without one, address) was not seen within the delay."""
    timed = listings.withColumn("__time", F.col("scraped_at").cast("timestamp")).withWatermark("__time", delay)
    key = F.coalesce(F.concat(F.lit("v:"), vin_key()), F.concat(F.lit("u:"), F.lower("vehicle_url")))
    return timed.withColumn("__key", key).dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__time")
