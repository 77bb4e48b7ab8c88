"""Duplicate listings (D1-D5) as partial aggregates per key, and unions.

The order of the input is given by ``order``: columns that together say which row came
first; of rows equal in all of them one stays. Nothing is ordered: every decision is a
minimum over one key's rows, and whole rows are joined with the decisions once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def vin_key(vin: str | Column = "vin") -> Column:
    """The VIN without white space around it, in capitals; null if absent or empty (blanks give '')."""
    vin = F.col(vin) if isinstance(vin, str) else vin
    return F.when(vin != "", F.upper(strip(vin)))


def url_key(url: str | Column = "vehicle_url") -> Column:
    return F.lower(strip(url))


def _order(order: Sequence[str]) -> Column:
    """One comparable value per row; equal ones are the same place in the input."""
    return F.struct(*[F.col(c) for c in order])


def _lateness(rows: DataFrame, prefer_latest: bool) -> Column:
    """Sorts the newest time first and absent times last; all alike if time does not matter."""
    if not prefer_latest:
        return F.lit(0)
    return F.struct(F.col("t").isNull(), F.lit("2000-01-01 00:00:00").cast(rows.schema["t"].dataType) - F.col("t"))


def _minima(rows: DataFrame, key: str, prefer_latest: bool, *more: str) -> DataFrame:
    """Per key: ``r``, its first row (o, t, more), ``late``, its newest one, and ``n``, its rows.

    Minima of structs, so they are combined before the exchange and a key that holds a third
    of the rows costs one row per task; minima of parts can be combined again at any time.
    """
    return rows.groupBy(key).agg(
        F.min(F.struct("o", "t", *more)).alias("r"),
        F.min(F.struct(_lateness(rows, prefer_latest).alias("late"), "o", "t", *more)).alias("late"),
        F.count("*").alias("n"),
    )


def _combined(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(F.min("r").alias("r"), F.min("late").alias("late"), F.sum("n").alias("n"))


def _decided(found: DataFrame, key: str, *more: str) -> DataFrame:
    """Minima with ``w``, the row that wins over ``r``: the newest one, unless the first has no time."""
    w = F.when(F.col("r.t").isNull(), F.col("r")).otherwise(F.struct("late.o", "late.t", *[f"late.{m}" for m in more]))
    return found.select(key, "r", w.alias("w"), "n")


def _narrow(listings: DataFrame, order: Sequence[str]) -> DataFrame:
    """Only keys, places and times decide."""
    return listings.select(vin_key().alias("vk"), url_key().alias("uk"), _order(order).alias("o"), F.col("scraped_at").alias("t"))


def _of_vins(minima: DataFrame) -> DataFrame:
    """Representatives (o, t, uk, w: place of the VIN's winner, n) of VINs."""
    return _decided(minima, "vk", "uk").select("r.o", "r.t", "r.uk", F.col("w.o").alias("w"), "n")


def _alone(narrow: DataFrame) -> DataFrame:
    """Rows without a VIN stand for themselves and go through no exchange for it."""
    return narrow.where("vk is null").select("o", "t", "uk", F.col("o").alias("w"), F.lit(1).cast("long").alias("n"))


def _stages(listings: DataFrame, order: Sequence[str], prefer_latest: bool) -> tuple[DataFrame, DataFrame]:
    """Representatives of VINs and of rows without one, and the choice per address."""
    narrow = _narrow(listings, order)
    representatives = _of_vins(_minima(narrow.where("vk is not null"), "vk", prefer_latest, "uk")).union(_alone(narrow))
    return representatives, _decided(_minima(representatives, "uk", prefer_latest, "w"), "uk", "w")


def choices(listings: DataFrame, order: Sequence[str], prefer_latest: bool = True) -> tuple[DataFrame, DataFrame]:
    """What a part of the rows says about D1: minima per VIN, and per address of rows without one."""
    narrow = _narrow(listings, order)
    return _minima(narrow.where("vk is not null"), "vk", prefer_latest, "uk"), _minima(_alone(narrow), "uk", prefer_latest, "w")


def deduplicate_parts(rows: DataFrame, by_vin: DataFrame, by_url: DataFrame, order: Sequence[str], prefer_latest: bool = True) -> DataFrame:
    """D1 over rows of many parts from the ``choices`` of each part, without deciding on the rows anew."""
    representatives = _of_vins(_combined(by_vin, "vk"))
    addresses = _minima(representatives, "uk", prefer_latest, "w").unionByName(by_url)
    return _at(rows, order, _survivors(representatives, _decided(_combined(addresses, "uk"), "uk", "w")))


def _survivors(representatives: DataFrame, by_url: DataFrame) -> DataFrame:
    """(o): addresses' choices that are their VIN's choice too, and VINs' choices that did not come first."""
    return by_url.where(F.col("w.o") == F.col("w.w")).select("w.o").union(representatives.where("o != w").select(F.col("w").alias("o")))


def _at(rows: DataFrame, order: Sequence[str], places: DataFrame) -> DataFrame:
    """The rows at the given places (o), one of each: the only exchange of whole rows, by a key of its own for each."""
    placed = rows.withColumn("__o", _order(order)).join(places.withColumnRenamed("o", "__p"), F.col("__o") == F.col("__p"), "left_semi")
    one = F.row_number().over(Window.partitionBy("__o").orderBy("__o"))
    return placed.withColumn("__one", one).where("__one = 1").select(*rows.columns)


def deduplicate(listings: DataFrame, order: Sequence[str], prefer_latest: bool = True) -> DataFrame:
    """One row per VIN, then one per address among the first rows of the VINs.

    A later row of a VIN that beats the first one stays even if the first one lost on its
    address: what survives is each address's choice that is its VIN's choice too, and each
    VIN's choice that did not come first.
    """
    return _at(listings, order, _survivors(*_stages(listings, order, prefer_latest)))


def dedup_stats(listings: DataFrame, order: Sequence[str], prefer_latest: bool = True) -> DataFrame:
    """A10: one row: total, duplicates_by_vin, duplicates_by_url, final."""
    representatives, by_url = _stages(listings, order, prefer_latest)
    count = lambda what: F.coalesce(F.sum(what), F.lit(0)).cast("long")
    of_vins = representatives.agg(count(F.col("n")).alias("total"), count(F.col("n") - 1).alias("duplicates_by_vin"), F.count_if(F.col("o") != F.col("w")).alias("later"))
    of_urls = by_url.agg(count(F.col("n") - 1).alias("duplicates_by_url"), F.count_if(F.col("w.o") == F.col("w.w")).alias("chosen"))
    return of_vins.crossJoin(of_urls).select("total", "duplicates_by_vin", "duplicates_by_url", (F.col("later") + F.col("chosen")).alias("final"))  # one row each


def _keep_first(rows: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    keyed = rows.withColumn("__key", key)
    firsts = keyed.where("__key is not null").groupBy("__key").agg(F.min(_order(order)).alias("o")).select("o")
    return _at(keyed.where("__key is not null").select(*rows.columns), order, firsts).union(keyed.where("__key is null").select(*rows.columns))


def deduplicate_by_vin(listings: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row of each VIN; rows without one stay."""
    return _keep_first(listings, vin_key(), order)


def deduplicate_by_url(listings: DataFrame, order: Sequence[str], url: str = "vehicle_url") -> DataFrame:
    """D3: the first row of each address; rows without one stay."""
    return _keep_first(listings, F.when(F.col(url) != "", url_key(url)), order)


def latest_per_key(rows: DataFrame, key: str, time: str, *ties: str) -> DataFrame:
    """The newest row of each key, later ties by the given columns."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(time).desc_nulls_last(), *[F.col(t) for t in ties]))
    return rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with their place within a key's group, so that a filter's order can be shown."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def distinct_in_order(values: Column) -> Column:
    """An array without repeats, first places kept."""
    return F.array_distinct(values)


def union_sites(*sites: DataFrame) -> DataFrame:
    """All rows of all sites (and of a restored state), missing columns as nulls."""
    out = sites[0]
    for site in sites[1:]:
        out = out.unionByName(site, allowMissingColumns=True)
    return out
