"""Lookups of dealers and sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean_city, state_of_city


def dealer_by_name(dealers: DataFrame, name: str, order: str = "ord") -> DataFrame:
    """L1: the first dealer whose name contains the text, in any case."""
    return dealers.where(F.contains(F.lower("name"), F.lit(name.lower()))).orderBy(order).limit(1)


def dealers_by_city(dealers: DataFrame, city: str) -> DataFrame:
    """L2: all dealers whose city contains the text, in any case."""
    return dealers.where(F.contains(F.lower("city"), F.lit(city.lower())))


def stamp_dealer(listings: DataFrame, dealers: DataFrame, key: str = "dealer_id") -> DataFrame:
    """Put name, website, city and state of its dealer on every listing.

    An inner join on the dealer's key; Spark broadcasts the dealers if they are small enough.
    """
    side = dealers.select(F.col("id").alias("__id"), F.col("name").alias("dealer_name"), F.col("website").alias("dealer_website"), clean_city("city").alias("dealer_location_city"), state_of_city("city").alias("dealer_location_state"))
    kept = [c for c in listings.columns if c not in side.columns]
    return listings.select(*kept).join(side, F.col(key) == F.col("__id")).drop("__id")


def unknown_sites(wanted: Sequence[str], registered: Sequence[str]) -> list[str]:
    """The names that no plug-in answers to."""
    known = set(registered)
    return [name for name in wanted if name not in known]
