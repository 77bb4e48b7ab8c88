"""The listing record: its columns, types and the constraints a row must meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _INT, _MONEY, _LIST = T.StringType(), T.IntegerType(), T.DoubleType(), T.ArrayType(T.StringType(), False)

#: Fixed: the 30 stored columns, in CSV order.
LISTING = T.StructType(
    [
        T.StructField(name, kind, True)
        for name, kind in (
            ("dealer_name", _TEXT),
            ("dealer_website", _TEXT),
            ("vehicle_url", _TEXT),
            ("year", _INT),
            ("make", _TEXT),
            ("model", _TEXT),
            ("trim", _TEXT),
            ("new_used", _TEXT),
            ("fuel_type", _TEXT),
            ("drivetrain", _TEXT),
            ("transmission", _TEXT),
            ("body_style", _TEXT),
            ("msrp", _MONEY),
            ("sale_price", _MONEY),
            ("total_price", _MONEY),
            ("currency", _TEXT),
            ("price_note", _TEXT),
            ("vin", _TEXT),
            ("stock_number", _TEXT),
            ("mileage", _INT),
            ("mileage_units", _TEXT),
            ("in_stock_status", _TEXT),
            ("exterior_color", _TEXT),
            ("interior_color", _TEXT),
            ("dealer_location_city", _TEXT),
            ("dealer_location_state", _TEXT),
            ("description", _TEXT),
            ("features", _LIST),
            ("images", _LIST),
            ("scraped_at", T.TimestampNTZType()),
        )
    ]
)
COLUMNS = LISTING.names
REQUIRED = ("dealer_name", "dealer_website", "vehicle_url", "make", "model")
CONDITIONS = ("new", "used", "cpo")
#: Values that columns take when a source lacks them.
DEFAULTS = {"new_used": "new", "currency": "USD", "mileage_units": "mi"}


def is_constructible(as_of_year: int) -> Column:
    """Whether a row meets the record's constraints: never null.

    Required strings are not empty, the year lies in 1900..as_of_year + 1, the condition
    is known, mileage and prices are absent or not negative (a NaN price is not negative).
    """
    ok = F.col("year").between(1900, as_of_year + 1) & F.col("new_used").isin(*CONDITIONS)
    for name in REQUIRED:
        ok = ok & (F.col(name) != "")
    for name in ("mileage", "msrp", "sale_price", "total_price"):
        ok = ok & ~F.coalesce(F.col(name) < 0, F.lit(False))
    return F.coalesce(ok, F.lit(False))
