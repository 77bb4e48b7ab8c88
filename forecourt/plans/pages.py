"""Plans over captured pages: candidate addresses, next-link closure, summary to detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import next_page, page_error, page_facts, pagination, vehicle_cards
from ..operators.filters import is_vehicle_url
from ..sources.shared import stored

#: Fixed: where inventories usually are, in the order in which they are tried.
INVENTORY_PATHS = ("/inventory", "/new-inventory", "/inventory/new", "/new-vehicles", "/vehicles/new", "/search/new", "/inventory/index.htm", "/new")


def inventory_candidates(dealers: DataFrame) -> DataFrame:
    """(id, pos, url): the known inventory address alone, else the usual ones and the site itself."""
    usual = F.array(*[F.concat("website", F.lit(p)) for p in INVENTORY_PATHS], F.col("website"))
    tried = F.when(F.col("new_inventory_url").isNotNull(), F.array("new_inventory_url")).otherwise(usual)
    return dealers.select("id", "website", F.col("new_inventory_url").isNotNull().alias("known"), F.posexplode(tried).alias("pos", "url"))


def inventory_urls(dealers: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, url): the known address, else the first captured candidate that looks like an inventory, else /inventory."""
    tried = inventory_candidates(dealers)
    # Only captured candidates are parsed; a known address needs no look at its page.
    asked = tried.where(~F.col("known")).select(F.col("url").alias("__asked")).distinct()
    held = pages.join(asked, F.col("url") == F.col("__asked"), "left_semi")
    looks = held.select(F.col("url").alias("__url"), page_facts("html", "url", "url")["inventory"].alias("inventory"))
    hits = tried.join(looks, F.col("url") == F.col("__url"), "left").where(F.col("known") | F.col("inventory"))
    best = hits.groupBy("id").agg(F.min_by("url", "pos").alias("found")).withColumnRenamed("id", "__id")
    return dealers.join(best, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("found", F.concat("website", F.lit("/inventory"))).alias("url"))


def listing_urls(dealers: DataFrame, pages: DataFrame, profile: str = "generic", most: int = 50) -> DataFrame:
    """E5: (id, url): list pages to read; with pagination for the generic profile only."""
    if profile == "template":
        return dealers.select("id", F.concat("website", F.lit("/inventory")).alias("url"))
    first = inventory_urls(dealers, pages)
    if profile == "rendered":
        return first
    first = stored(first)
    wanted = first.select(F.col("url").alias("__first")).distinct()
    held = pages.join(wanted, F.col("url") == F.col("__first"), "left_semi").select(F.col("url").alias("__url"), pagination("html", "url").alias("more"))
    more = first.join(held, F.col("url") == F.col("__url")).select("id", F.explode("more").alias("url"))
    chain = next_closure(first, pages, most).select("id", "url")
    return first.unionByName(more).unionByName(chain).distinct()


def next_closure(starts: DataFrame, pages: DataFrame, most: int = 50) -> DataFrame:
    """(id, level, url): pages reached from (id, url) by next links, at most ``most`` steps, each once."""
    return follow(starts, pages.select("url", next_page("html", "url").alias("next_url")), most)


def follow(starts: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """The closure over captured edges (url, next_url), by pointer doubling.

    A table of jumps leads from each address to the one 2**k steps on; joined with itself it
    gives the next table. Chains known up to 2**k steps, joined with it once, are known up to
    twice as many: six rounds for 50 steps, each written before the next one reads it, and no
    row but those of the result and of cycles.

    A chain ends where it meets a page it has been to. From there on it only repeats itself,
    so what counts is each address's first level in a chain. Of several captures of an
    address the smallest next link counts; repeated starts give repeated rows; a null or
    unknown address leads nowhere.
    """
    links = edges.where("next_url IS NOT NULL AND url <> next_url").groupBy("url").agg(F.min("next_url").alias("next_url"))
    jumps, step = stored(links.select(F.col("url").alias("at"), F.col("next_url").alias("to"))), 1
    begun = starts.select(F.col("url").alias("start")).distinct()
    chains = stored(begun.join(jumps, F.col("start") == F.col("at")).select("start", F.lit(1).alias("level"), F.col("to").alias("url")))
    while step < most:
        more = stored(chains.where(F.col("level") + step <= most).join(jumps, F.col("url") == F.col("at")).select("start", (F.col("level") + step).alias("level"), F.col("to").alias("url")))
        if more.isEmpty():
            break
        chains, step = chains.union(more), 2 * step
        if step < most:
            on = jumps.select(F.col("at").alias("via"), F.col("to").alias("on"))
            jumps = stored(jumps.join(on, F.col("to") == F.col("via")).select("at", F.col("on").alias("to")))
    first = chains.where("url <> start").groupBy("start", "url").agg(F.min("level").alias("level"))
    named = starts.select("id", F.col("url").alias("__start"))
    return named.join(first, F.col("__start") == F.col("start")).select("id", "level", "url")


def failed_pages(pages: DataFrame, profile: str = "generic") -> DataFrame:
    """(url, error) of the pages (url, html) that extraction skips, with the reason: the dead letters of a run."""
    return pages.select("url", page_error("html", "url", "url", profile).alias("error")).where("error IS NOT NULL")


def summaries(list_pages: DataFrame, profile: str = "generic") -> DataFrame:
    """H4: (page_url, detail_url, title, price) of all cards of rows (url, html, base)."""
    return list_pages.select(F.col("url").alias("page_url"), F.inline(vehicle_cards("html", "base", profile)))


def details(found: DataFrame, pages: DataFrame) -> DataFrame:
    """The captured detail pages of summaries, each address once."""
    wanted = found.where(is_vehicle_url("detail_url")).select("detail_url").distinct()
    return wanted.join(pages, F.col("detail_url") == F.col("url")).drop("detail_url")
