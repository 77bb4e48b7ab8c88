"""The dealer dimension (S4) and plug-in registration from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, strip


#: Fixed: the dealer file's name, and where it is looked for.
DEALER_FILES = ("dealerships.csv", "../dealerships.csv")


def find_dealers(spark: SparkSession, *more: str, usual: Sequence[str] = DEALER_FILES) -> str:
    """The first path that exists, of the given ones, then of the usual places; the first usual one if none does."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return next((p for p in (*more, *usual) if path(p).getFileSystem(conf).exists(path(p))), usual[0])


def read_dealers(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, name, website, new_inventory_url, city) from either layout of dealer CSV.

    Modern: id, name, base_url[, new_inventory_url, city]. Legacy: Dealership Name, Website
    [, City]; the id is then made from the name. Rows without a key or without an http
    address are skipped; another header is an error. ``ord`` keeps the order of the file.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = set(raw.columns)
    cell = lambda name: F.coalesce(strip(F.col(f"`{name}`")), F.lit("")) if name in names else F.lit("")
    if {"id", "name", "base_url"} <= names:
        rows = raw.select(cell("id").alias("id"), cell("name").alias("name"), cell("base_url").alias("website"), blank_to_null(cell("new_inventory_url")).alias("new_inventory_url"), cell("city").alias("city"))
    elif {"Dealership Name", "Website"} <= names:
        name = cell("Dealership Name")
        rows = raw.select(F.translate(F.replace(F.lower(name), F.lit(" "), F.lit("_")), ",()", "").alias("id"), name.alias("name"), cell("Website").alias("website"), F.lit(None).cast("string").alias("new_inventory_url"), cell("City").alias("city"))
    else:
        raise ValueError("neither (id, name, base_url) nor (Dealership Name, Website) stand in the header")
    kept = rows.withColumn("ord", F.monotonically_increasing_id()).where("id != '' and name != '' and website != ''").where(F.col("website").startswith("http://") | F.col("website").startswith("https://"))
    no_slash = lambda c: F.regexp_replace(c, "/+$", "")
    return kept.select("ord", "id", "name", no_slash("website").alias("website"), no_slash("new_inventory_url").alias("new_inventory_url"), "city")
