"""The three ways in (Entry A, B, C): pages or listings to validated, deduplicated, filtered rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import slug
from ..functions.extract import listings_of_pages
from ..operators import dedup, quality, stats
from ..operators.filters import FilterSpec, filter_listings, remaining
from ..operators.lookups import unknown_sites
from ..operators.robots import allowed_pages, url_host
from ..schema import is_constructible
from ..sources.shared import stored
from .pages import details, listing_urls, summaries

#: Tells listings of pages apart: by address, then by what the page says.
PAGE_ORDER = ("vehicle_url", "scraped_at", "vin", "stock_number", "year", "make", "model", "msrp")

Site = Callable[[DataFrame], DataFrame]
_SITES: dict[str, Site] = {}


@dataclass(frozen=True)
class SitePlan:
    """The three points where a site may differ, each with the general way as its default.

    ``urls``: (dealers, pages) to (id, url) of list pages; ``cards``: list pages (url, html,
    base) to (page_url, detail_url, title, price); ``details``: detail pages (url, html,
    dealer_name, dealer_website, city) to listings. A plan is a plug-in: called with captured
    pages (url, html, dealer_name, dealer_website, city) it goes from one to the next.
    """

    details: Callable[[DataFrame], DataFrame]
    urls: Callable[[DataFrame, DataFrame], DataFrame] = listing_urls
    cards: Callable[[DataFrame], DataFrame] = summaries

    def __call__(self, pages: DataFrame) -> DataFrame:
        dealers = pages.select(F.col("dealer_name").alias("id"), F.col("dealer_website").alias("website"), F.lit(None).cast("string").alias("new_inventory_url")).distinct()
        wanted = self.urls(dealers, pages).select(F.col("url").alias("__url")).distinct()
        found = self.cards(pages.join(wanted, F.col("url") == F.col("__url"), "left_semi").withColumn("base", F.col("dealer_website")))
        return self.details(details(found, pages))


@dataclass(frozen=True)
class _Dealer:
    """A plug-in made from a row of the dealer dimension."""

    name: str
    website: str
    city: str | None
    extract: Site

    def __call__(self, pages: DataFrame) -> DataFrame:
        return _of_dealers(pages, [self])


def _of_dealers(pages: DataFrame, dealers: Sequence[_Dealer]) -> DataFrame:
    """One join of the pages with all the dealers, by host; a page belongs to the dealer whose address it starts with."""
    side = pages.sparkSession.createDataFrame([(d.name, d.website, d.city) for d in dealers], "dealer_name string, dealer_website string, city string")
    side = side.withColumn("__host", url_host("dealer_website"))
    # Named by the caller, so few: Spark knows their size and broadcasts them while they are small.
    rows = pages.select("url", "html").join(side, (url_host("url") == F.col("__host")) & F.startswith("url", F.col("dealer_website"))).drop("__host")
    return dealers[0].extract(rows)


def register_site(name: str, extract: Site) -> None:
    """A plug-in from captured pages to listings; the last one of a name counts."""
    _SITES[name] = extract


def sites() -> list[str]:
    return list(_SITES)


def register_dealers(dealers: DataFrame, *, as_of_year: int, scraped_at: Column, profile: str = "generic") -> list[str]:
    """A plug-in for each dealer of a (small) dimension, under its slug."""
    extract = partial(listings_of_pages, as_of_year=as_of_year, scraped_at=scraped_at, profile=profile)
    names = []
    for row in dealers.select(slug("name").alias("slug"), "name", "website", "city").collect():
        register_site(row.slug, _Dealer(row.name, row.website, row.city, extract))
        names.append(row.slug)
    return names


@dataclass(frozen=True)
class Result:
    """Outcomes of a run. ``unique`` is read by several of them: persist it to decide once."""

    validated: DataFrame
    unique: DataFrame
    filtered: DataFrame
    dedup_stats: DataFrame

    def report(self) -> DataFrame:
        return quality.validation_counts(self.validated)

    def issues(self) -> DataFrame:
        return quality.top_issues(self.validated)

    def summary(self) -> DataFrame:
        return stats.price_stats(self.filtered, priced_only=False)

    def by_make(self) -> DataFrame:
        return stats.count_by_make(self.filtered)


def run_listings(listings: DataFrame, order: Sequence[str], spec: FilterSpec | None = None, *, as_of_year: int, strict: bool = False) -> Result:
    """Entry C: validate, then deduplicate, then filter. The order matters and is kept.

    Valid rows are stored, since deciding duplicates reads them three times and the rules
    are dear; the rest of the result is lazy.
    """
    sound = listings.where(is_constructible(as_of_year))
    validated = quality.validate(sound, as_of_year=as_of_year, strict=strict)
    valid = stored(quality.valid_only(sound, as_of_year=as_of_year, strict=strict), compiled=True)
    unique = dedup.deduplicate(valid, order)
    return Result(validated, unique, filter_listings(unique, spec, as_of_year=as_of_year), dedup.dedup_stats(valid, order))


def run_pages(pages: DataFrame, dealers: DataFrame, done: DataFrame, spec: FilterSpec | None = None, *, as_of_year: int, scraped_at: Column, rules: DataFrame | None = None, profile: str = "generic") -> Result:
    """Entry A: captured pages (dealer_id, url, html) of dealers that are not yet done.

    Pages are parsed once: their listings are stored before duplicates are decided.
    """
    left = remaining(dealers, done)
    fetched = allowed_pages(pages, rules) if rules is not None else pages
    side = left.select(F.col("id").alias("__id"), F.col("name").alias("dealer_name"), F.col("website").alias("dealer_website"), "city")
    rows = fetched.join(side, F.col("dealer_id") == F.col("__id")).drop("__id")
    return run_listings(stored(listings_of_pages(rows, as_of_year=as_of_year, scraped_at=scraped_at, profile=profile)), PAGE_ORDER, spec, as_of_year=as_of_year)


def run_sites(pages: DataFrame, names: Sequence[str], spec: FilterSpec | None = None, *, as_of_year: int) -> Result:
    """Entry B: the named plug-ins over captured pages; an unknown name is an error.

    Plug-ins of dealers that were registered together read the pages once.
    """
    unknown = unknown_sites(names, sites())
    if unknown:
        raise ValueError(f"unknown sites {unknown}; known are {sites()}")
    together: dict[int, list[_Dealer]] = {}
    others = []
    for site in (_SITES[n] for n in names):
        together.setdefault(id(site.extract), []).append(site) if isinstance(site, _Dealer) else others.append(site)
    found = [site(pages) for site in others] + [_of_dealers(pages, group) for group in together.values()]
    return run_listings(stored(dedup.union_sites(*found)), PAGE_ORDER, spec, as_of_year=as_of_year)
