"""Computed columns of a listing."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import false_if_null, strip

#: Fixed: fuel words that mean an electric vehicle.
ELECTRIC_FUELS = ("electric", "ev", "bev", "phev", "plug-in", "plugin")


def price() -> Column:
    """The first of sale, total and list price that is neither absent nor 0; else 0."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0.0)) for c in ("sale_price", "total_price", "msrp")], F.lit(0.0))


def is_electric() -> Column:
    """Whether the fuel is one of the electric words, in any case."""
    return false_if_null(F.lower("fuel_type").isin(*ELECTRIC_FUELS))


def is_new(as_of_year: int, max_mileage: int = 200) -> Column:
    """Condition new, and few miles or, without mileage, of last year or later."""
    recent = F.when(F.col("mileage").isNull(), F.col("year") >= as_of_year - 1).otherwise(F.col("mileage") <= max_mileage)
    return false_if_null((F.col("new_used") == "new") & recent)


def with_computed(listings: DataFrame) -> DataFrame:
    """The stored columns and price, is_electric, url and dealership."""
    return listings.withColumns({"price": price(), "is_electric": is_electric(), "url": F.col("vehicle_url"), "dealership": F.col("dealer_name")})


def state_of_city(city: str | Column) -> Column:
    """OR or WA by what the city's name contains; OR by default (the upper-cased "OR" wins)."""
    city = F.col(city) if isinstance(city, str) else city
    oregon = F.upper(city).contains("OR") | city.contains("Oregon")
    washington = F.upper(city).contains("WA") | city.contains("Washington")
    return F.when(oregon, "OR").when(washington, "WA").otherwise("OR")


def clean_city(city: str | Column) -> Column:
    """A city without a bracketed addition; as it is if there is none."""
    city = F.col(city) if isinstance(city, str) else city
    return F.when(city.contains("("), strip(F.substring_index(city, "(", 1))).otherwise(city)


def slug(name: str | Column) -> Column:
    """Lower case; blank, hyphen and slash become underscores; other signs go."""
    name = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.translate(F.lower(name), " -/", "___"), "[^a-z0-9_]", "")


def absolute_url(base: str | Column, link: str | Column) -> Column:
    """A link resolved against its base; null if either is null or the link is malformed."""

    @F.arrow_udf(T.StringType())
    def resolve(bases: pa.Array, links: pa.Array) -> pa.Array:
        def one(b, x):
            try:
                return None if b is None or x is None else urljoin(b, x)
            except ValueError:
                return None

        return pa.array([one(b, x) for b, x in zip(bases.to_pylist(), links.to_pylist())], pa.string())

    return resolve(base, link)


