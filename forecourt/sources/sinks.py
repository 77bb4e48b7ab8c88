"""Writing listings as JSON, JSON lines and CSV (K1-K4, K7)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import with_computed
from ..schema import COLUMNS
from . import documents
from .shared import cleaned

#: Of compressed lines, which no two tasks can share: about 100 MB of text a file.
ROWS_A_FILE = 125_000


def iso(time: Column) -> Column:
    """ISO 8601 with microseconds only where there are some."""
    return F.regexp_replace(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def csv_row(listings: DataFrame) -> DataFrame:
    """K3: the 30 columns as CSV shows them: '' for null, lists joined, no line breaks in descriptions."""
    cells = []
    for name in COLUMNS:
        c = F.col(name)
        if name in ("features", "images"):
            c = F.array_join(c, "; ")
        elif name == "description":
            c = F.translate(c, "\r\n", "  ")
        elif name == "scraped_at":
            c = iso(c)
        elif name == "year":
            c = F.nullif(c, F.lit(0)).cast("string")
        cells.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
    return listings.select(*cells)


def write_csv(listings: DataFrame, path: str, mode: str = "overwrite", single: bool = False) -> None:
    """K2: CSV with a header, also for no rows; one file only if asked for."""
    rows = csv_row(listings)
    (rows.coalesce(1) if single else rows).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def json_rows(listings: DataFrame) -> DataFrame:
    """P5: stored and computed columns with the time as ISO text."""
    return with_computed(listings.select(*COLUMNS)).withColumn("scraped_at", iso(F.col("scraped_at")))


def write_jsonl(listings: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """K5's line format, for any size: one listing a line; plain text unless a compression is named."""
    out = json_rows(listings).write.mode(mode).option("ignoreNullFields", False)
    if compression:
        out = out.option("compression", compression).option("maxRecordsPerFile", ROWS_A_FILE)
    with cleaned(listings.sparkSession):
        out.json(path)


def write_json(listings: DataFrame, path: str, timestamp: str, pretty: bool = True, mode: str = "overwrite", source: str = "multi-dealership") -> None:
    """K1: one document {metadata, cars} of any size, with one car a line if pretty."""

    def header(n: int) -> str:
        return f'{{"metadata":{json.dumps({"timestamp": timestamp, "total_listings": n, "source": source}, ensure_ascii=False)},"cars":[' + "\n" * pretty

    rows = json_rows(listings).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    documents.write_document(rows, path, header, "]}\n", mode, pretty)


def write_state(listings: DataFrame, done: DataFrame, path: str) -> None:
    """S2's counterpart: a document of completed_dealerships and one of scraped_listings, side by side."""
    cars = json_rows(listings).select(F.to_json(F.struct(*COLUMNS)))
    names = done.select(F.to_json(F.array("name")).alias("name")).select(F.expr("substr(name, 2, length(name) - 2)"))
    documents.write_document(cars, path, lambda n: '{"scraped_listings":[\n', "]}\n")
    documents.write_document(names, path, lambda n: '{"completed_dealerships":[\n', "]}\n", mode="append")


def save(listings: DataFrame, path: str, format: str | None = None, timestamp: str = "1970-01-01T00:00:00", mode: str = "overwrite") -> None:
    """K4: by format, or by the path's ending: .csv, .jsonl (lines, Q9), anything else JSON."""
    kind = format if format and format != "auto" else "csv" if path.endswith(".csv") else "jsonl" if path.endswith(".jsonl") else "json"
    if kind == "csv":
        write_csv(listings, path, mode)
    elif kind == "jsonl":
        write_jsonl(listings, path, mode)
    elif kind == "json":
        write_json(listings, path, timestamp, mode=mode)
    else:
        raise ValueError(f"unknown format {kind!r}")


def append(listings: DataFrame, path: str, format: str | None = None, timestamp: str = "1970-01-01T00:00:00") -> None:
    """K5: put rows behind what a path holds, as further files (CSV, lines) or documents; nothing is rewritten."""
    save(listings, path, format, timestamp, mode="append")


def count_saved(spark: SparkSession, path: str, format: str) -> int:
    """K7: rows in an output."""
    if format == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).count()
    if format == "jsonl":
        return spark.read.text(path).where("value != ''").count()
    return documents.items(documents.pieces(spark, path, "cars")).count()
