"""The inventory filter (F1-F21): a specification compiled to one predicate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ELECTRIC_FUELS, is_electric, is_new, price
from ..functions.text import false_if_null

Names = Sequence[str] | None


@dataclass(frozen=True)
class FilterSpec:
    """What to keep. None leaves a criterion out; an empty list of wanted values keeps nothing."""

    is_electric: bool = True
    max_price: float = 60000
    new_only: bool = True
    max_mileage: int = 200
    fuel_types: Names = None
    min_price: float | None = None
    min_year: int | None = None
    max_year: int | None = None
    makes: Names = None
    models: Names = None
    exclude_makes: Names = None
    exclude_models: Names = None
    drivetrains: Names = None
    exclude_drivetrains: Names = None
    dealers: Names = None
    exclude_dealers: Names = None
    cities: Names = None
    states: Names = None
    availability_status: Names = None
    exclude_status: Names = None

    @classmethod
    def everything(cls, **wanted) -> FilterSpec:
        """A specification that keeps all rows but for what is asked."""
        return cls(**{"is_electric": False, "max_price": float("inf"), "new_only": False, "exclude_status": ()} | wanted)

    @classmethod
    def names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))


def _in(column: Column, values: Sequence[str]) -> Column:
    """Membership that is false for null, and for every value if the list is empty."""
    return false_if_null(column.isin(*values)) if len(values) else F.lit(False)


def _absent(column: Column) -> Column:
    return column.isNull() | (column == "")


def fuel_predicate(spec: FilterSpec) -> Column:
    """listed fuels, or electric ones whatever the list says; no test if not wanted."""
    if not spec.is_electric:
        return F.lit(True)
    listed = ELECTRIC_FUELS if spec.fuel_types is None else [x.lower() for x in spec.fuel_types]
    return _in(F.lower("fuel_type"), listed) | is_electric()


def predicates(spec: FilterSpec, as_of_year: int) -> dict[str, Column]:
    """The criteria in use, by their id; every one is true or false, never null."""
    c, cost = F.col, price()
    out = {"F1": fuel_predicate(spec)}
    if spec.max_price != float("inf"):
        out["F2"] = ~(cost > F.lit(float(spec.max_price))) | F.isnan(cost)
    if spec.min_price is not None:
        out["F3"] = (cost >= F.lit(float(spec.min_price))) | F.isnan(cost)
    if spec.min_year is not None:
        out["F4"] = c("year") >= spec.min_year
    if spec.max_year is not None:
        out["F5"] = c("year") <= spec.max_year
    for key, name, wanted in (("F6", "make", spec.makes), ("F7", "model", spec.models), ("F12", "dealer_name", spec.dealers)):
        if wanted is not None:
            out[key] = _in(c(name), wanted)
    for key, name, unwanted in (("F8", "make", spec.exclude_makes), ("F9", "model", spec.exclude_models), ("F13", "dealer_name", spec.exclude_dealers)):
        if unwanted:
            out[key] = ~_in(c(name), unwanted)
    drive = F.upper("drivetrain")
    if spec.drivetrains is not None:
        out["F10"] = _absent(c("drivetrain")) | _in(drive, [x.upper() for x in spec.drivetrains])
    if spec.exclude_drivetrains:
        out["F11"] = _absent(c("drivetrain")) | ~_in(drive, [x.upper() for x in spec.exclude_drivetrains])
    for key, name, wanted in (("F14", "dealer_location_city", spec.cities), ("F15", "dealer_location_state", spec.states)):
        if wanted is not None:
            out[key] = _absent(c(name)) | _in(c(name), wanted)
    unwanted = ("sold",) if spec.exclude_status is None else spec.exclude_status
    if unwanted:
        out["F16"] = ~_in(c("in_stock_status"), unwanted)
    if spec.availability_status is not None:
        out["F17"] = ~_absent(c("in_stock_status")) & _in(c("in_stock_status"), spec.availability_status)
    if spec.new_only:
        out["F18"] = is_new(as_of_year, spec.max_mileage)
    return {key: false_if_null(p) for key, p in out.items()}


def filter_listings(listings: DataFrame, spec: FilterSpec | None = None, *, as_of_year: int, **criteria) -> DataFrame:
    """The rows that meet all criteria; ordinal columns stay, so the order can be kept."""
    spec = spec or FilterSpec(**criteria)
    keep = F.lit(True)
    for predicate in predicates(spec, as_of_year).values():
        keep = keep & predicate
    return listings.where(keep)


def remaining(dealers: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Dealers whose name is not among the completed ones (null names remain)."""
    return dealers.join(done.select(F.col(name).alias("__done")).distinct(), F.col(name) == F.col("__done"), "left_anti")


#: Fixed: parts of addresses that are no vehicle pages.
OTHER_PAGES = ("/contact", "/about", "/financing", "/service", "/directions")


def is_vehicle_url(url: str | Column, pagination: bool = False) -> Column:
    """an http address without a part that names another kind of page."""
    url = F.col(url) if isinstance(url, str) else url
    other = OTHER_PAGES[:-1] if pagination else OTHER_PAGES
    found = F.lit(False)
    for part in other:
        found = found | F.lower(url).contains(part)
    return false_if_null((url.startswith("http://") | url.startswith("https://")) & ~found)
