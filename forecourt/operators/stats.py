"""Summaries of listings (A3-A9, A11, A12) and their orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_electric, price
from ..functions.text import blank_to_null


def price_stats(listings: DataFrame, priced_only: bool = True) -> DataFrame:
    """A3 (priced rows) and A4 (all rows): number, lowest, highest and mean price."""
    rows = listings.select(price().alias("price"))
    rows = rows.where("price > 0") if priced_only else rows
    return rows.agg(F.count("*").alias("n"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("price").alias("avg_price"))


def count_by_make(listings: DataFrame, top: int | None = None, first: Sequence[str] = ()) -> DataFrame:
    """A5, O2, O3: rows per make, most first; ties in order of first appearance, then by name."""
    order = F.min(F.struct(*first)) if first else F.lit(0)
    counted = listings.groupBy("make").agg(F.count("*").alias("n"), order.alias("__first"))
    by = [F.desc("n"), "__first", "make"]
    counted = counted.orderBy(*by)
    return (counted.limit(top) if top else counted).select("make", "n")


def count_by_drivetrain(listings: DataFrame) -> DataFrame:
    """Rows per drivetrain, absent ones as Unknown."""
    return listings.groupBy(F.coalesce(blank_to_null("drivetrain"), F.lit("Unknown")).alias("drivetrain")).agg(F.count("*").alias("n"))


def shares(listings: DataFrame) -> DataFrame:
    """Electric and new rows, and their percentages to one decimal (null without rows)."""
    n = F.count("*")
    out = [n.alias("n")]
    for name, what in (("electric", is_electric()), ("new", F.coalesce(F.col("new_used") == "new", F.lit(False)))):
        out += [F.count_if(what).alias(name), F.round(100 * F.count_if(what) / F.nullif(n, F.lit(0)), 1).alias(f"{name}_percent")]
    return listings.agg(*out)


def pass_rate(listings: DataFrame, keep: Column) -> DataFrame:
    """Rows, rows that meet a condition, and their percentage."""
    n = F.count("*")
    return listings.agg(n.alias("n"), F.count_if(keep).alias("passed"), F.round(100 * F.count_if(keep) / F.nullif(n, F.lit(0)), 1).alias("percent"))


def count_by_dealer(listings: DataFrame) -> DataFrame:
    """Rows per dealer."""
    return listings.groupBy("dealer_name").agg(F.count("*").alias("n"))


def progress(listings: DataFrame, done: DataFrame) -> DataFrame:
    """Completed dealers and gathered listings."""
    return done.agg(F.countDistinct("name").alias("completed")).crossJoin(listings.agg(F.count("*").alias("listings")))


def sample(listings: DataFrame, order: Sequence[str], n: int = 3) -> DataFrame:
    """The first rows."""
    return listings.orderBy(*order).limit(n)


def first_items(values: str, n: int) -> Column:
    """The first items of an array."""
    return F.slice(values, 1, n)
