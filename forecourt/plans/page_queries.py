"""Queries over constructed pages, saved documents and settings, with SQL for what they must find."""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as P
from ..functions import html as H
from ..functions.extract import listings_of_pages
from ..operators import dedup, filters, lookups, robots
from ..operators.filters import FilterSpec
from ..sources import config, sinks
from ..sources import dealers as dealer_source
from ..sources import listings as sources
from ..sources.shared import scratch, stored
from ..streaming import ingest
from . import made_pages as M
from . import pages as plan
from . import pipeline
from .catalogue import _L, YEAR, add
from .views import KEYS, listings, table

_C = f"WITH cars AS ({M.duckdb(M.CARS)}) "
_now = lambda: F.lit("2024-01-01 00:00:00")  # noqa: E731 - a column needs a session


def extracted(spark: SparkSession, sf_dir: str, profile: str = "generic", only: tuple[str, ...] | None = None) -> DataFrame:
    return listings_of_pages(M.details(spark, sf_dir), as_of_year=YEAR, scraped_at=_now(), profile=profile, only=only)


def facts(spark: SparkSession, sf_dir: str, profile: str = "generic") -> DataFrame:
    return M.details(spark, sf_dir).select("m", H.page_facts("html", "dealer_website", "url", profile).alias("f"))


_SALE = "41000.0E0 + m % 1000"
_FUEL = "CASE m % 5 WHEN 0 THEN 'electric' WHEN 1 THEN 'phev' WHEN 2 THEN 'gasoline' WHEN 3 THEN 'electric' END"
_CONDITION = "CASE WHEN m % 7 = 0 OR m % 3 = 0 THEN 'new' WHEN m % 3 = 1 THEN 'used' ELSE 'cpo' END"
_STATUS = "CASE m % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'sold' WHEN 2 THEN 'in_transit' END"
_DESCRIPTION = "concat('A quiet and roomy ride with a long list of extras, number ', m, '.')"
#: query, its columns, and what they must be by what the pages were made of.
_FOUND = {
    "h5_listing_of_page": (("year", "make", "model", "new_used", "in_stock_status"), f"year, make, concat(model, ' SEL') AS model, {_CONDITION} AS new_used, {_STATUS} AS in_stock_status"),
    "x22_page_prices": (("msrp", "sale_price", "total_price"), f"45000.0E0 + m % 1000 AS msrp, {_SALE} AS sale_price, CASE WHEN m % 2 = 1 THEN 43000.0E0 + m % 1000 ELSE {_SALE} END AS total_price"),
    "x23_page_vin": (("vin",), "vin"),
    "x24_page_stock": (("stock_number",), "CASE m % 2 WHEN 0 THEN concat('S', m) ELSE concat('S', m, ' b') END AS stock_number"),
    "x26_page_mileage": (("mileage", "mileage_units"), "CAST(CASE m % 3 WHEN 0 THEN 1000 + m % 1000 WHEN 1 THEN CAST(concat('12', t3) AS INT) END AS INT) AS mileage, CASE m % 3 WHEN 1 THEN 'km' ELSE 'mi' END AS mileage_units"),
    "x28_page_fuel": (("fuel_type",), f"{_FUEL} AS fuel_type"),
    "x30_page_colors": (("exterior_color", "interior_color"), "CASE m % 4 WHEN 1 THEN 'Blue exterior' WHEN 3 THEN NULL ELSE 'Red' END AS exterior_color, CASE m % 2 WHEN 0 THEN 'Black' END AS interior_color"),
    "x31_page_drivetrain": (("drivetrain", "body_style"), "CASE m % 3 WHEN 2 THEN NULL ELSE 'AWD' END AS drivetrain, CASE m % 2 WHEN 0 THEN 'SUV' ELSE 'Sedan' END AS body_style"),
    "x32_page_transmission": (("transmission",), "CASE m % 2 WHEN 0 THEN '8-Speed Automatic' END AS transmission"),
    "h6_images": (("images",), "[concat(dealer_website, '/vehicle/', m, '.jpg')] AS images"),
    "h7_description": (("description",), f"{_DESCRIPTION} AS description"),
    "h8_features": (("features",), "['Heated seats', concat('Camera ', m)] AS features"),
    "j2_page_dealer": (("dealer_name", "dealer_website", "dealer_location_city", "dealer_location_state"), "dealer_name, dealer_website, CASE WHEN s % 2 = 0 THEN 'Portland' ELSE 'Vancouver Washington' END AS dealer_location_city, CASE WHEN s % 2 = 0 THEN 'OR' ELSE 'WA' END AS dealer_location_state"),
}
for _name, (_columns, _sql) in _FOUND.items():
    add(_name, lambda spark, d, c=_columns: extracted(spark, d, only=("vehicle_url", *c)).select("vehicle_url", *c), f"{_C} SELECT url AS vehicle_url, {_sql} FROM cars")
# The template takes the first block of its kind and items marked as features; the rendered profile takes none.
add("h13_template_page", lambda spark, d: extracted(spark, d, "template").select("vehicle_url", "make", "description", "features", "images", "dealer_location_city"), f"{_C} SELECT url AS vehicle_url, make, {_DESCRIPTION} AS description, ['Heated seats'] AS features, [concat(dealer_website, '/vehicle/', m, '.jpg')] AS images, CAST(NULL AS VARCHAR) AS dealer_location_city FROM cars")
add("h14_rendered_page", lambda spark, d: extracted(spark, d, "rendered").select("vehicle_url", "year", "make", "description", "features", "images"), f"{_C} SELECT url AS vehicle_url, year, make, CAST(NULL AS VARCHAR) AS description, CAST([] AS VARCHAR[]) AS features, [concat(dealer_website, '/vehicle/', m, '.jpg')] AS images FROM cars")
add("h1_structured_fuel", lambda spark, d: facts(spark, d).select("m", F.try_variant_get(H.json_ld(F.col("f.json_ld")), "$.fuelType", "string").alias("fuel")), f"{_C} SELECT m, CASE m % 5 WHEN 0 THEN 'Electric' WHEN 1 THEN 'Plug-In Hybrid' END AS fuel FROM cars")
add("x34_labelled_values", lambda spark, d: facts(spark, d).select("m", F.try_element_at("f.values", F.lit("vin")).alias("vin"), F.try_element_at("f.values", F.lit("mileage")).alias("mileage")), f"{_C} SELECT m, CASE m % 2 WHEN 0 THEN vin ELSE concat(substr(vin, 1, 3), '-', substr(vin, 4)) END AS vin, CASE m % 3 WHEN 0 THEN '{M.FILLER.strip()}' WHEN 1 THEN concat('12', t3, ' km') END AS mileage FROM cars")
add("h3_status_elements", lambda spark, d: facts(spark, d).select("m", F.array_distinct(F.filter("f.statuses", lambda t: F.length(t) < 12)).alias("statuses")), f"{_C} SELECT m, CASE m % 4 WHEN 0 THEN ['In Stock'] WHEN 1 THEN ['Sold'] WHEN 2 THEN ['On the Way'] ELSE CAST([] AS VARCHAR[]) END AS statuses FROM cars")
add("h9_inventory_of_made_pages", lambda spark, d: M.lists(spark, d).union(M.details(spark, d).select("s", "url", F.col("dealer_website").alias("base"), "html")).union(M.lists(spark, d).select("s", F.concat("url", F.lit("#plain")), "base", F.lit("<p>Nothing here</p>"))).select("url", H.page_facts("html", "base", "url")["inventory"].alias("inventory")), f"{_C} SELECT url, true AS inventory FROM cars UNION ALL SELECT concat('https://d', s_suppkey, '.net/inventory', e), e = '' FROM supplier, (VALUES (''), ('#plain')) t(e)")

# List pages.

_ONE = "SELECT s_suppkey AS s, i, concat('https://d', s_suppkey, '.net/inventory') AS page_url, concat('https://d', s_suppkey, '.net/vehicle/', s_suppkey * 10 + i) AS detail_url, concat('2024 Kia ', i) AS title, (40000 + i * 1000 + s_suppkey % 1000)::DOUBLE AS price FROM supplier, range(1, 5) t(i) WHERE s_suppkey % 5 >= i"
add("h4_cards", lambda spark, d: plan.summaries(M.lists(spark, d)), f"SELECT page_url, detail_url, title, CASE WHEN s % 5 > 1 THEN price END AS price FROM ({_ONE})")
add("h13_template_cards", lambda spark, d: plan.summaries(M.lists(spark, d), "template"), f"SELECT page_url, detail_url, title, price FROM ({_ONE})")
add("h14_rendered_cards", lambda spark, d: plan.summaries(M.lists(spark, d), "rendered"), f"SELECT page_url, detail_url, title, price FROM ({_ONE}) WHERE s % 5 > 1")
add("h10_made_pagination", lambda spark, d: M.lists(spark, d).select("s", F.explode(H.pagination("html", "url")).alias("url")), "SELECT s_suppkey AS s, concat('https://d', s_suppkey, '.net/inventory?page=', i) AS url FROM supplier, range(2, 4) t(i)")
add("h11_next_page", lambda spark, d: M.lists(spark, d).select("s", H.next_page("html", "url").alias("url")), "SELECT s_suppkey AS s, concat('https://d', s_suppkey, '.net/inventory?page=3') AS url FROM supplier")
add("p09_resolved_links", lambda spark, d: M.lists(spark, d).select("s", P.absolute_url("url", F.concat(F.lit("../a/./b?x="), "s")).alias("up"), P.absolute_url("url", F.lit("?q=1#z")).alias("query"), P.absolute_url("url", F.lit("//o.org/x")).alias("other")), "SELECT s_suppkey AS s, concat('https://d', s_suppkey, '.net/a/b?x=', s_suppkey) AS up, concat('https://d', s_suppkey, '.net/inventory?q=1#z') AS query, 'https://o.org/x' AS other FROM supplier")
add("e5_listing_urls", lambda spark, d: plan.listing_urls(M.dealers(spark, d), M.lists(spark, d)), "SELECT s_suppkey AS id, concat('https://d', s_suppkey, '.net/all') AS url FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, concat('https://d', s_suppkey, '.net/inventory', p) FROM supplier, (VALUES (''), ('?page=2'), ('?page=3')) t(p) WHERE s_suppkey % 3 <> 0")
add("j5_detail_pages", lambda spark, d: plan.details(plan.summaries(M.lists(spark, d)), M.details(spark, d)).select("m", "url"), f"SELECT s * 10 + i AS m, detail_url AS url FROM ({_ONE})")

# The ways in.


def _captured(spark: SparkSession, d: str) -> DataFrame:
    made = M.details(spark, d).select("url", "html", "dealer_name", "dealer_website", "city", F.col("s").alias("dealer_id"))
    of = M.dealers(spark, d).select(F.col("id").alias("dealer_id"), F.col("name").alias("dealer_name"), F.col("website").alias("dealer_website"), "city")
    return made.unionByName(M.lists(spark, d).select("url", "html", F.col("s").alias("dealer_id")).join(of, "dealer_id"))


_SPEC = FilterSpec.everything(max_price=41500, exclude_status=None)
_RULES = "User-agent: *\nDisallow: /vehicle/*3$\nDisallow: /inventory"
#: Every page has a VIN and an address of its own; valid are the electric ones of plausible years.
_VALID = f"year >= 2015 AND ({_FUEL} IN ('electric', 'phev') OR make IN ('Tesla') OR regexp_matches(lower(concat(model, ' SEL')), 'electric|ev|e-tron|eq|id\\.|i4|ix|ioniq|mach-e|lightning|bolt|leaf')) AND coalesce({_FUEL} <> 'gasoline', true) AND NOT regexp_matches(lower(vin), '000000|999999')"
_KEPT = f"{_SALE} <= 41500 AND coalesce({_STATUS} <> 'sold', true)"


def entry_a(spark: SparkSession, d: str) -> DataFrame:
    """Pages of dealers that are not done, as far as robots rules allow, to filtered listings."""
    done = M.dealers(spark, d).where("id % 4 = 0").select("name")
    hosts = M.lists(spark, d).select(robots.url_host("url").alias("host"), F.lit(_RULES).alias("robots"))
    pages = M.details(spark, d).select(F.col("s").alias("dealer_id"), "url", "html")
    return pipeline.run_pages(pages, M.dealers(spark, d), done, _SPEC, as_of_year=YEAR, scraped_at=_now(), rules=robots.parse_rules(hosts)).filtered.select("vehicle_url", "vin", "sale_price")


def entry_b(spark: SparkSession, d: str) -> DataFrame:
    """The plug-ins of registered dealers over all captured pages."""
    names = pipeline.register_dealers(M.dealers(spark, d), as_of_year=YEAR, scraped_at=_now())
    return pipeline.run_sites(_captured(spark, d).where("url like '%/vehicle/%'"), names, _SPEC, as_of_year=YEAR).filtered.select("vehicle_url", "vin", "sale_price")


def site_plan(spark: SparkSession, d: str) -> DataFrame:
    """A site's plan from list pages over cards to details, with cards of its own."""
    own = pipeline.SitePlan(details=partial(listings_of_pages, as_of_year=YEAR, scraped_at=_now()), cards=partial(plan.summaries, profile="rendered"))
    pipeline.register_site("own_plan", own)
    return own(_captured(spark, d)).select("vehicle_url", "vin")


add("e3_run_pages", entry_a, f"{_C} SELECT url AS vehicle_url, vin, {_SALE} AS sale_price FROM cars WHERE {_VALID} AND {_KEPT} AND s % 4 <> 0 AND m % 10 <> 3")
add("e1_run_sites", entry_b, f"{_C} SELECT url AS vehicle_url, vin, {_SALE} AS sale_price FROM cars WHERE {_VALID} AND {_KEPT}")
_DEEP = 20_000


def with_bad_pages(spark: SparkSession, d: str) -> DataFrame:
    """The constructed pages, with every 50th dealer's list page full of open elements and two pages that no parser should take."""
    lists = M.lists(spark, d).select("url", "html", "base")
    deep = F.concat(F.repeat(F.lit('<div class="item">'), _DEEP), F.lit("<p>In Stock</p>"))
    bad = M.dealers(spark, d).where("id % 50 = 1").select(F.concat("website", F.lit("/deep")).alias("url"), deep.alias("html"), F.col("website").alias("base"))
    # Dealt out once more: the deep pages are a hundred times as long as the others and come from one small table.
    return lists.union(bad.repartition(spark.sparkContext.defaultParallelism))


def cards_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """The table function in SQL, over pages dealt out by host."""
    H.register_table_functions(spark)
    pages = M.lists(spark, d).select("url", "html", "base", robots.url_host("url").alias("host"))
    return spark.sql("SELECT page_url, detail_url, title, price FROM cards_of_pages(TABLE({pages}) PARTITION BY host) WHERE error IS NULL", pages=pages)


def links_by_sql(spark: SparkSession, d: str) -> DataFrame:
    """The lateral function in SQL."""
    H.register_table_functions(spark)
    return spark.sql("SELECT s, l.page_url AS url FROM {pages}, LATERAL page_links(html, url) l", pages=M.lists(spark, d))


add("e4_all_pages_read", lambda spark, d: with_bad_pages(spark, d).select("url", H.page_facts("html", "base", "url")["inventory"].alias("inventory")), "SELECT concat('https://d', s_suppkey, '.net/inventory') AS url, true AS inventory FROM supplier UNION ALL SELECT concat('https://d', s_suppkey, '.net/deep'), true FROM supplier WHERE s_suppkey % 50 = 1")
add("e4_failed_pages", lambda spark, d: plan.failed_pages(with_bad_pages(spark, d)), "SELECT s_name AS url, s_name AS error FROM supplier WHERE false")
add("e1_cards_by_sql", cards_by_sql, f"SELECT page_url, detail_url, title, CASE WHEN s % 5 > 1 THEN price END AS price FROM ({_ONE})")
add("e1_links_by_sql", links_by_sql, "SELECT s_suppkey AS s, concat('https://d', s_suppkey, '.net/inventory?page=', i) AS url FROM supplier, range(2, 4) t(i)")
add("e2_site_plan", site_plan, f"SELECT detail_url AS vehicle_url, concat('1HGCM82', lpad(concat('X', s * 10 + i), 10, '7')) AS vin FROM ({_ONE}) WHERE s % 5 > 1")
add("j4_unknown_sites", lambda spark, d: spark.createDataFrame([(n,) for n in lookups.unknown_sites(["a", "b", "c", "b"], ["c", "a"])], "name string"), "SELECT * FROM (VALUES ('b'), ('b')) t(name)")
add("u2_restored_state", lambda spark, d: dedup.union_sites(extracted(spark, d, only=("vehicle_url", "vin", "year")).select("vehicle_url", "vin", "year"), listings(spark, d).select("vehicle_url", "make")), f"{_C.rstrip()}, {_L.removeprefix('WITH ')} SELECT url AS vehicle_url, vin, year, NULL AS make FROM cars UNION ALL SELECT vehicle_url, NULL, NULL, make FROM listings")
add("f19_order_kept", lambda spark, d: dedup.ranked(filters.filter_listings(listings(spark, d), FilterSpec.everything(makes=["Kia"]), as_of_year=YEAR), "dealer_name", "ord").select(*KEYS, "rank"), f"{_L} SELECT {', '.join(KEYS)}, row_number() OVER (PARTITION BY dealer_name ORDER BY ord) AS rank FROM listings WHERE make = 'Kia'")
add("f20_some_remain", lambda spark, d: filters.remaining(M.dealers(spark, d), listings(spark, d).where("make = 'Tesla' AND trim = 'Demo'").select(F.col("dealer_name").alias("name"))).select("id", "name"), f"{_L} SELECT s_suppkey AS id, concat('Dealer ', s_suppkey) AS name FROM supplier WHERE concat('Dealer ', s_suppkey) NOT IN (SELECT dealer_name FROM listings WHERE make = 'Tesla' AND trim = 'Demo')")

# Saved documents, dealers, settings.

_SAVED = ("vehicle_url", "year", "vin", "sale_price", "description", "features", "images")
_SAVED_SQL = f"{_C} SELECT url AS vehicle_url, year, vin, {_SALE} AS sale_price, {_DESCRIPTION} AS description, ['Heated seats', concat('Camera ', m)] AS features, [concat(dealer_website, '/vehicle/', m, '.jpg')] AS images FROM cars"


def saved_as(kind: str, spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/cars.{kind}"
    sinks.save(extracted(spark, d), path)
    reader = {"json": sources.read_json, "jsonl": sources.read_jsonl, "csv": sources.read_csv}[kind]
    return reader(spark, path, as_of_year=YEAR).select(*_SAVED)


def saved_counts(spark: SparkSession, d: str) -> DataFrame:
    home, rows = scratch(spark), []
    cars = stored(extracted(spark, d))
    for kind in ("csv", "json", "jsonl"):
        for times in (1, 2):
            sinks.append(cars, f"{home}/saved.{kind}")
            rows.append((kind, times, sinks.count_saved(spark, f"{home}/saved.{kind}", kind)))
    return spark.createDataFrame(rows, "kind string, times int, n long")


def state(spark: SparkSession, d: str) -> DataFrame:
    home = scratch(spark)
    sinks.write_state(extracted(spark, d), M.dealers(spark, d).select("name"), f"{home}/state.json")
    cars, done = sources.read_state(spark, f"{home}/state.json")
    return cars.select(F.col("vehicle_url").alias("item"), F.lit("listing").alias("kind")).union(done.select("name", F.lit("dealer")))


def dealer_file(modern: bool, spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(spark)}/dealers.csv"
    rows = M.dealers(spark, d)
    named = rows.select(F.col("id").cast("string").alias("id"), "name", F.concat("website", F.lit("/")).alias("base_url"), "new_inventory_url", "city") if modern else rows.select(F.col("name").alias("Dealership Name"), F.when(F.col("id") % 5 == 0, F.lit("ftp://x")).otherwise(F.col("website")).alias("Website"), F.col("city").alias("City"))
    named.write.option("header", True).csv(path)
    return dealer_source.read_dealers(spark, path).select("id", "name", "website", "new_inventory_url", "city")


for _kind in ("json", "jsonl", "csv"):
    add(f"k4_saved_{_kind}", partial(saved_as, _kind), _SAVED_SQL)
add("k7_saved_counts", saved_counts, "SELECT kind, times, (times * 4 * (SELECT count(*) FROM supplier))::BIGINT AS n FROM (VALUES ('csv'), ('json'), ('jsonl')) a(kind), (VALUES (1), (2)) b(times)")
add("s2_saved_state", state, f"{_C} SELECT url AS item, 'listing' AS kind FROM cars UNION ALL SELECT concat('Dealer ', s_suppkey), 'dealer' FROM supplier")
_CITY = "CASE WHEN s_suppkey % 2 = 0 THEN 'Portland (East)' ELSE 'Vancouver Washington' END AS city"
add("s4_dealers", partial(dealer_file, True), f"SELECT s_suppkey::VARCHAR AS id, concat('Dealer ', s_suppkey) AS name, concat('https://d', s_suppkey, '.net') AS website, CASE WHEN s_suppkey % 3 = 0 THEN concat('https://d', s_suppkey, '.net/all') END AS new_inventory_url, {_CITY} FROM supplier")
add("s4_legacy_dealers", partial(dealer_file, False), f"SELECT concat('dealer_', s_suppkey) AS id, concat('Dealer ', s_suppkey) AS name, concat('https://d', s_suppkey, '.net') AS website, NULL AS new_inventory_url, {_CITY} FROM supplier WHERE s_suppkey % 5 <> 0")


def settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings out and in again, an explicit one on top, applied as a filter."""
    saved = config.RunSpec(filter=FilterSpec.everything(max_price=70000, makes=["Kia", "Ford"], exclude_status=None)).to_dict()
    read = config.RunSpec.from_dict(json.loads(json.dumps(saved)) | {"unknown": 1}, max_price=60000)
    return filters.filter_listings(listings(spark, d), read.filter, as_of_year=YEAR).select(*KEYS)


_PRICE = "coalesce(nullif(sale_price, 0), nullif(total_price, 0), nullif(msrp, 0), 0)"
add("s5_settings", settings, f"{_L} SELECT {', '.join(KEYS)} FROM listings WHERE {_PRICE} <= 60000 AND make IN ('Kia', 'Ford') AND coalesce(in_stock_status, '') <> 'sold'")
add("s8_robots_of_hosts", lambda spark, d: robots.parse_rules(M.dealers(spark, d).select(robots.url_host("website").alias("host"), F.concat(F.lit("# x\nDisallow: /early\nUser-agent: *\nDisallow: /private/"), "id", F.lit("\nAllow: \nUSER-AGENT: a, B\nallow: /"), "id", F.lit("\n")).alias("robots"))).select("host", "agent", "allow", "path"), "SELECT concat('d', s_suppkey, '.net') AS host, a AS agent, l AS allow, concat(p, s_suppkey) AS path FROM supplier, (VALUES ('*', false, '/private/'), ('a', true, '/'), ('b', true, '/')) t(a, l, p)")


def ingested(clear: bool, spark: SparkSession, d: str) -> DataFrame:
    """A stream of captured pages, read to its end twice; dealers without a listing are done as well."""
    home = scratch(spark)
    pages = M.details(spark, d).select("url", F.when(F.col("s") % 3 == 0, F.lit("")).otherwise(F.col("html")).alias("html"), "dealer_name", "dealer_website", "city")
    pages.write.parquet(f"{home}/pages")
    extract = partial(listings_of_pages, as_of_year=YEAR, scraped_at=_now())
    for _ in range(2):  # the second finds nothing new
        stream = spark.readStream.schema(pages.schema).parquet(f"{home}/pages")
        ingest.ingest_pages(stream, f"{home}/state", f"{home}/checkpoint", extract).awaitTermination()
    if clear:
        ingest.clear(spark, f"{home}/state")
    found = ingest.gathered(spark, f"{home}/state").select(F.col("vehicle_url").alias("item"))
    return found.union(ingest.completed(spark, f"{home}/state"))


def streamed(kind: str, spark: SparkSession, d: str) -> DataFrame:
    """K5: a stream of listings appended as a format, by a second run of the same batches as well."""
    home = scratch(spark)
    cars = extracted(spark, d)
    cars.write.parquet(f"{home}/cars")
    for run in range(2):  # a new checkpoint numbers its batches anew: the second run replaces the first one's
        stream = spark.readStream.schema(cars.schema).parquet(f"{home}/cars")
        ingest.append_stream(stream, f"{home}/out", f"{home}/checkpoint{run}", format=kind).awaitTermination()
    reader = {"json": sources.read_json, "jsonl": sources.read_jsonl, "csv": sources.read_csv}[kind]
    return reader(spark, f"{home}/out", as_of_year=YEAR).select(*_SAVED)


for _kind in ("json", "jsonl", "csv"):
    add(f"k5_streamed_{_kind}", partial(streamed, _kind), _SAVED_SQL)
add("c1_ingested_pages", partial(ingested, False), f"{_C} SELECT url AS item FROM cars WHERE s % 3 <> 0 UNION ALL SELECT concat('Dealer ', s_suppkey) FROM supplier")
add("c2_cleared_state", partial(ingested, True), "SELECT s_name AS item FROM supplier WHERE false")
