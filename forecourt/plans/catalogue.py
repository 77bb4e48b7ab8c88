"""Every query of the engine by name, with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as P
from ..functions import extract as X
from ..functions import html as H
from ..functions import normalize as N
from ..functions import patterns, text
from ..operators import dedup, filters, lookups, quality, robots, stats
from ..operators.filters import FilterSpec
from ..schema import is_constructible
from ..sources import sinks
from . import pages as pages_plan
from .pipeline import run_listings
from .views import KEYS, LISTINGS, RENDERED, ROBOTS, duckdb_view, listings, rendered, table

Query = Callable[[SparkSession, str], DataFrame]
YEAR = 2024
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_KEYS = ", ".join(KEYS)
_L = f"WITH listings AS ({duckdb_view(LISTINGS)}) "
_R = f"WITH rendered AS ({duckdb_view(RENDERED)}) "
_PRICE = "coalesce(nullif(sale_price, 0), nullif(total_price, 0), nullif(msrp, 0), 0)"
_ELECTRIC = "coalesce(lower(fuel_type) IN ('electric', 'ev', 'bev', 'phev', 'plug-in', 'plugin'), false)"
_NEW = f"(new_used = 'new' AND CASE WHEN mileage IS NULL THEN year >= {YEAR - 1} ELSE mileage <= 200 END)"


def _counts(sql: str) -> str:
    """count_if as a filtered count, which is a BIGINT in both engines."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9 : end - 1]}){sql[end:]}"
    return sql


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = _counts(sql)


def on_listings(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(listings(spark, d))


# Flagship.

FLAGSHIP = FilterSpec()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Electric, affordable, new vehicles by make, with their prices."""
    kept = filters.filter_listings(listings(spark, sf_dir), FLAGSHIP, as_of_year=YEAR)
    cost = P.price()
    return kept.groupBy("make").agg(F.count("*").alias("n"), F.min(cost).alias("min_price"), F.max(cost).alias("max_price"), F.round(F.avg(cost), 2).alias("avg_price"))


add(
    "flagship_ev_by_make",
    flagship,
    f"{_L} SELECT make, count(*) AS n, min({_PRICE}) AS min_price, max({_PRICE}) AS max_price, round(avg({_PRICE}), 2) AS avg_price FROM listings WHERE {_ELECTRIC} AND {_PRICE} <= 60000 AND coalesce(in_stock_status <> 'sold', true) AND {_NEW} GROUP BY make",
)

# Filters.

_FILTERS: dict[str, tuple[dict, str]] = {
    "f01_electric": ({"is_electric": True}, _ELECTRIC),
    "f01b_fuel_types": ({"is_electric": True, "fuel_types": ["Hybrid"]}, f"({_ELECTRIC} OR coalesce(lower(fuel_type) = 'hybrid', false))"),
    "f02_max_price": ({"max_price": 60000}, f"{_PRICE} <= 60000"),
    "f03_min_price": ({"min_price": 20000}, f"{_PRICE} >= 20000"),
    "f04_min_year": ({"min_year": 2020}, "year >= 2020"),
    "f05_max_year": ({"max_year": 2022}, "year <= 2022"),
    "f06_makes": ({"makes": ["Kia", "Tesla", "ford"]}, "make IN ('Kia', 'Tesla')"),
    "f07_models": ({"models": ["EV6", "Bolt"]}, "model IN ('EV6', 'Bolt')"),
    "f08_exclude_makes": ({"exclude_makes": ["Nissan"]}, "make <> 'Nissan'"),
    "f09_exclude_models": ({"exclude_models": ["Leaf", "Tahoe"]}, "model NOT IN ('Leaf', 'Tahoe')"),
    "f10_drivetrains": ({"drivetrains": ["awd", "FWD"]}, "(drivetrain IS NULL OR drivetrain = '' OR upper(drivetrain) IN ('AWD', 'FWD'))"),
    "f11_exclude_drivetrains": ({"exclude_drivetrains": ["fwd"]}, "(drivetrain IS NULL OR upper(drivetrain) <> 'FWD')"),
    "f12_dealers": ({"dealers": ["Dealer 3", "Dealer 5"]}, "dealer_name IN ('Dealer 3', 'Dealer 5')"),
    "f13_exclude_dealers": ({"exclude_dealers": ["Dealer 3"]}, "dealer_name <> 'Dealer 3'"),
    "f14_cities": ({"cities": ["Portland"]}, "(dealer_location_city IS NULL OR dealer_location_city IN ('', 'Portland'))"),
    "f15_states": ({"states": ["WA"]}, "(dealer_location_state IS NULL OR dealer_location_state IN ('', 'WA'))"),
    "f16_exclude_status": ({"exclude_status": None}, "(in_stock_status IS NULL OR in_stock_status <> 'sold')"),
    "f17_availability": ({"availability_status": ["available", ""]}, "coalesce(in_stock_status = 'available', false)"),
    "f18_new_only": ({"new_only": True}, _NEW),
    "f19_nothing_wanted": ({"makes": []}, "false"),
    "f_combined": (
        {"is_electric": True, "max_price": 80000, "min_price": 1, "min_year": 2018, "makes": ["Kia", "Hyundai", "Ford"], "exclude_models": ["Escape"], "drivetrains": ["AWD"], "states": ["OR"], "exclude_status": None, "new_only": True},
        f"{_ELECTRIC} AND {_PRICE} <= 80000 AND {_PRICE} >= 1 AND year >= 2018 AND make IN ('Kia', 'Hyundai', 'Ford') AND model <> 'Escape' AND (coalesce(drivetrain, '') = '' OR upper(drivetrain) = 'AWD') AND coalesce(dealer_location_state, '') IN ('', 'OR') AND coalesce(in_stock_status, '') <> 'sold' AND {_NEW}",
    ),
}


def _filter(spec: FilterSpec, spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_listings(listings(spark, sf_dir), spec, as_of_year=YEAR).select(*KEYS, P.price().alias("price"))


for _name, (_wanted, _where) in _FILTERS.items():
    add(_name, partial(_filter, FilterSpec.everything(**_wanted)), f"{_L} SELECT {_KEYS}, {_PRICE} AS price FROM listings WHERE {_where}")

add(
    "f20_remaining_dealers",
    lambda spark, d: filters.remaining(table(spark, d, "supplier").select(F.concat(F.lit("Dealer "), "s_suppkey").alias("name")), listings(spark, d).where("in_stock_status = 'sold'").select(F.col("dealer_name").alias("name"))),
    f"{_L} SELECT concat('Dealer ', s_suppkey) AS name FROM supplier WHERE concat('Dealer ', s_suppkey) NOT IN (SELECT dealer_name FROM listings WHERE in_stock_status = 'sold')",
)
add(
    "f22_vehicle_urls",
    lambda spark, d: table(spark, d, "pages").select("page_id", "url", filters.is_vehicle_url("url").alias("vehicle"), filters.is_vehicle_url("url", pagination=True).alias("page")),
    "SELECT page_id, url, regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), '/(contact|about|financing|service|directions)') AS vehicle, regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(url), '/(contact|about|financing|service)') AS page FROM pages",
)

# Computed columns.


def _select(spark: SparkSession, sf_dir: str, **cols: Column) -> DataFrame:
    return listings(spark, sf_dir).select(*KEYS, *[c.alias(n) for n, c in cols.items()])


_OK = "coalesce(dealer_name <> '' AND dealer_website <> '' AND vehicle_url <> '' AND make <> '' AND model <> '' AND year BETWEEN 1900 AND 2025 AND new_used IN ('new', 'used', 'cpo') AND coalesce(mileage >= 0, true) AND coalesce(msrp >= 0, true) AND coalesce(sale_price >= 0, true) AND coalesce(total_price >= 0, true), false)"
_STATE = "CASE WHEN upper(dealer_location_city) LIKE '%OR%' OR dealer_location_city LIKE '%Oregon%' THEN 'OR' WHEN upper(dealer_location_city) LIKE '%WA%' THEN 'WA' ELSE 'OR' END"
for _name, _make, _sql in (
    ("p01_price", lambda: {"price": P.price()}, f"{_PRICE} AS price"),
    ("p02_is_electric", lambda: {"is_electric": P.is_electric()}, f"{_ELECTRIC} AS is_electric"),
    ("p03_aliases", lambda: {"url": F.col("vehicle_url"), "dealership": F.col("dealer_name")}, "vehicle_url AS url, dealer_name AS dealership"),
    ("p04_is_new", lambda: {"is_new": P.is_new(YEAR, 150)}, f"(new_used = 'new' AND CASE WHEN mileage IS NULL THEN year >= {YEAR - 1} ELSE mileage <= 150 END) AS is_new"),
    ("p06_state", lambda: {"state": P.state_of_city("dealer_location_city")}, f"{_STATE} AS state"),
    ("p07_city", lambda: {"city": P.clean_city("dealer_location_city")}, "CASE WHEN dealer_location_city LIKE '%(%' THEN trim(split_part(dealer_location_city, '(', 1)) ELSE dealer_location_city END AS city"),
    ("p08_slug", lambda: {"slug": P.slug(F.concat("dealer_name", F.lit(" / New-"), "make"))}, "regexp_replace(replace(replace(replace(lower(concat(dealer_name, ' / New-', make)), ' ', '_'), '/', '_'), '-', '_'), '[^a-z0-9_]', '', 'g') AS slug"),
    ("s00_constructible", lambda: {"ok": is_constructible(YEAR)}, f"{_OK} AS ok"),
):
    add(_name, lambda spark, d, m=_make: _select(spark, d, **m()), f"{_L} SELECT {_KEYS}, {_sql} FROM listings")
add(
    "p05_full_row",
    on_listings(lambda df: sinks.json_rows(df).select("dealer_name", "vehicle_url", "year", "price", "is_electric", "url", "dealership", "scraped_at", "features")),
    f"{_L} SELECT dealer_name, vehicle_url, year, {_PRICE} AS price, {_ELECTRIC} AS is_electric, vehicle_url AS url, dealer_name AS dealership, strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at, features FROM listings",
)
add("p09_absolute_url", lambda spark, d: table(spark, d, "pages").select("page_id", P.absolute_url(F.col("url"), F.lit("../inventory?x=1")).alias("url")))

# Duplicates.

#: Keys, places and times only; each step is computed once.
_WIN = f""", k AS MATERIALIZED (SELECT {_KEYS}, ord, scraped_at, CASE WHEN vin <> '' THEN upper(trim(vin)) END AS vk, lower(trim(vehicle_url)) AS uk FROM listings),
v AS MATERIALIZED (SELECT *, vk IS NULL OR row_number() OVER (PARTITION BY vk ORDER BY ord) = 1 AS rep,
  vk IS NULL OR row_number() OVER (PARTITION BY vk ORDER BY scraped_at DESC NULLS LAST, ord) = 1 AS vwin FROM k),
u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY uk ORDER BY ord) = 1 AS ufirst, row_number() OVER (PARTITION BY uk ORDER BY scraped_at DESC NULLS LAST, ord) = 1 AS uwin FROM v WHERE rep),
f AS (SELECT {_KEYS} FROM u WHERE uwin AND vwin UNION ALL SELECT {_KEYS} FROM v WHERE vwin AND NOT rep) """
add("d1_dedup_survivors", on_listings(lambda df: dedup.deduplicate(df, ["ord"]).select(*KEYS)), f"{_L}{_WIN} SELECT {_KEYS} FROM f")
add(
    "d1_dedup_first_seen",
    on_listings(lambda df: dedup.deduplicate(df, ["ord"], prefer_latest=False).select(*KEYS)),
    f"{_L}{_WIN} SELECT {_KEYS} FROM u WHERE ufirst",
)
add(
    "d1_dedup_stats",
    on_listings(lambda df: dedup.dedup_stats(df, ["ord"])),
    f"{_L}{_WIN} SELECT (SELECT count(*) FROM v) AS total, (SELECT count(*) FROM v WHERE NOT rep) AS duplicates_by_vin, (SELECT count(*) FROM u WHERE NOT ufirst) AS duplicates_by_url, (SELECT count(*) FROM f) AS final",
)
add("d2_vin_only", on_listings(lambda df: dedup.deduplicate_by_vin(df, ["ord"]).select(*KEYS)), f"{_L}{_WIN} SELECT {_KEYS} FROM v WHERE rep")
add(
    "d3_url_only",
    on_listings(lambda df: dedup.deduplicate_by_url(df, ["ord"]).select(*KEYS)),
    f"{_L}{_WIN} SELECT {_KEYS} FROM k QUALIFY row_number() OVER (PARTITION BY uk ORDER BY ord) = 1",
)
add(
    "d3_pages_by_url",
    lambda spark, d: dedup.deduplicate_by_url(table(spark, d, "pages"), ["page_id"], url="url").select("page_id", "url"),
    "SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY lower(trim(url)) ORDER BY page_id) = 1",
)
add(
    "d4_distinct_in_order",
    on_listings(lambda df: df.select(*KEYS, dedup.distinct_in_order(F.concat("features", "features", F.array("make"))).alias("items"))),
    f"{_L} SELECT {_KEYS}, list_concat(features, [make]) AS items FROM listings",
)
add(
    "d_events_latest",
    lambda spark, d: dedup.latest_per_key(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "event_type", "value"),
    "SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1",
)
add(
    "u1_union_sites",
    on_listings(lambda df: dedup.union_sites(df.where("make = 'Kia'").select("dealer_name", "make", "model"), df.where("make = 'Ford'").select("make", "dealer_name"))),
    f"{_L} SELECT dealer_name, make, model FROM listings WHERE make = 'Kia' UNION ALL SELECT dealer_name, make, NULL FROM listings WHERE make = 'Ford'",
)

# Quality rules.

_HTTP = "coalesce(starts_with({0}, 'http'), false)"
_MODELS = ", ".join(f"'{m}'" for m in quality.ELECTRIC_MODELS)
_MAKES = ", ".join(f"'{m}'" for m in quality.ELECTRIC_MAKES)
_LIKELY = f"(make IN ({_MAKES}) OR model IN ({_MODELS}) OR regexp_matches(lower(model), 'electric|ev|e-tron|eq|id\\.|i4|ix|ioniq|mach-e|lightning|bolt|leaf') OR coalesce(regexp_matches(lower(fuel_type), 'electric|ev|plug'), false) OR {_ELECTRIC})"
_HOLDER = "(" + " OR ".join(f"coalesce(regexp_matches(lower({f}), 'test|example|sample|placeholder|demo|xxx|zzz|abc123|000000|999999'), false)" for f in quality.PLACEHOLDER_FIELDS) + ")"
_RANGES = ", ".join(f"('{a}', '{b}', {lo} * 0.6E0, {hi} * 1.3E0)" for a, b, lo, hi in quality.PRICE_RANGES)
_DOLLAR = "'$' || format('{{:,.0f}}', {0})"
_P = "price"
_TYPICAL = f"' for ' || make || ' ' || model || ' (typical: ' || {_DOLLAR.format('low')} || '-' || {_DOLLAR.format('high')} || ')'"
_VALIDATE = f"""{_L}, ranges(rmake, rmodel, low, high) AS (VALUES {_RANGES}),
priced AS (SELECT l.*, {_PRICE} AS price, low, high FROM listings l LEFT JOIN ranges ON make = rmake AND model = rmodel),
judged AS (SELECT *, list_filter([
  CASE WHEN coalesce(make, '') IN ('', 'Unknown') THEN 'Missing or unknown make' END,
  CASE WHEN coalesce(model, '') IN ('', 'Unknown') THEN 'Missing or unknown model' END,
  CASE WHEN year < 2015 THEN 'Year too old for electric vehicle: ' || year WHEN year > {YEAR + 2} THEN 'Year too far in future: ' || year END,
  CASE WHEN price <= 0 THEN STRICT_PRICE WHEN price < 5000 THEN 'Suspiciously low price: ' || {_DOLLAR.format(_P)} WHEN price > 250000 THEN 'Price exceeds maximum for target vehicles: ' || {_DOLLAR.format(_P)} END,
  CASE WHEN NOT {_HTTP.format('vehicle_url')} THEN 'Invalid or missing vehicle URL' END,
  CASE WHEN coalesce(dealer_name, '') = '' THEN 'Missing dealer name' END,
  CASE WHEN NOT {_HTTP.format('dealer_website')} THEN 'Invalid dealer website' END,
  CASE WHEN NOT {_LIKELY} THEN 'Vehicle does not appear to be electric: ' || year || ' ' || make || ' ' || model END,
  CASE WHEN regexp_matches(lower(fuel_type), 'gas|diesel|flex|e85') AND NOT regexp_matches(lower(fuel_type), 'hybrid|phev') THEN 'Non-electric fuel type: ' || fuel_type END,
  CASE WHEN mileage > 300000 THEN 'Extremely high mileage: ' || format('{{:,}}', mileage) END,
  CASE WHEN {_HOLDER} THEN 'Appears to be test/placeholder data' END], lambda x: x IS NOT NULL) AS errors,
 list_filter([
  CASE WHEN price <= 0 THEN LAX_PRICE END,
  CASE WHEN vin <> '' AND NOT regexp_full_match(vin, '[A-HJ-NPR-Z0-9]{{17}}') THEN 'WARNING: Invalid VIN format: ' || vin END,
  CASE WHEN coalesce(vin, '') = '' THEN STRICT_VIN END,
  CASE WHEN new_used = 'new' AND mileage > 500 THEN 'WARNING: High mileage for new car: ' || mileage END,
  CASE WHEN price > 0 AND price < low THEN 'WARNING: Price ' || {_DOLLAR.format(_P)} || ' seems low' || {_TYPICAL} WHEN price > high THEN 'WARNING: Price ' || {_DOLLAR.format(_P)} || ' seems high' || {_TYPICAL} END], lambda x: x IS NOT NULL) AS warns FROM priced) """
_LAX = _VALIDATE.replace("STRICT_PRICE", "NULL").replace("LAX_PRICE", "'WARNING: Missing price - may be ''call for price'' listing'").replace("STRICT_VIN", "NULL")
_STRICT = _VALIDATE.replace("STRICT_PRICE", "'Missing or zero price'").replace("LAX_PRICE", "NULL").replace("STRICT_VIN", "'WARNING: Missing VIN (harder to verify uniqueness)'")


def _validated(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    return quality.validate(listings(spark, d), as_of_year=YEAR, strict=strict)


for _name, _strict in (("v1_validate", False), ("v1_validate_strict", True)):
    add(_name, lambda spark, d, s=_strict: _validated(spark, d, s).select(*KEYS, "is_valid", F.array_join("issues", " | ").alias("issues")), f"{_STRICT if _strict else _LAX} SELECT {_KEYS}, len(errors) = 0 AS is_valid, array_to_string(list_concat(errors, warns), ' | ') AS issues FROM judged")
_KIND = "regexp_replace(regexp_replace(i, '\\$[\\d,]+', '$X', 'g'), '\\d{4}', 'YYYY', 'g')"
_HISTOGRAM = f"SELECT {_KIND} AS issue, count(*) AS n FROM (SELECT unnest(list_concat(errors, warns)) AS i FROM judged WHERE len(errors) > 0) GROUP BY 1"
add("f21_valid_only", on_listings(lambda df: quality.valid_only(df, as_of_year=YEAR).select(*KEYS)), f"{_LAX} SELECT {_KEYS} FROM judged WHERE len(errors) = 0")
add("v1_validate_counts", lambda spark, d: quality.validation_counts(_validated(spark, d)), f"{_LAX} SELECT count(*) AS total, count_if(len(errors) = 0) AS valid, count_if(len(errors) > 0) AS invalid, round(100 * count_if(len(errors) = 0) / count(*), 1) AS valid_percent, round(100 * count_if(len(errors) > 0) / count(*), 1) AS invalid_percent FROM judged")
add("v1_issues", lambda spark, d: quality.issue_histogram(_validated(spark, d)), f"{_LAX} {_HISTOGRAM}")
add("v5_top_issues", lambda spark, d: quality.top_issues(_validated(spark, d)), f"{_LAX} {_HISTOGRAM} ORDER BY n DESC, issue LIMIT 10")
add("v2_likely_ev", lambda spark, d: _select(spark, d, likely=quality.likely_electric()), f"{_L} SELECT {_KEYS}, {_LIKELY} AS likely FROM listings")
add("v3_price_range", on_listings(lambda df: quality.with_price_range(df).select(*KEYS, quality.price_range_warning().alias("warning"))), f"{_LAX} SELECT {_KEYS}, replace(list_filter(warns, lambda x: x LIKE '%seems%')[1], 'WARNING: ', '') AS warning FROM judged")
add("v4_placeholder", lambda spark, d: _select(spark, d, placeholder=quality.is_placeholder()), f"{_L} SELECT {_KEYS}, {_HOLDER} AS placeholder FROM listings")

# Summaries.

_STATS = f"count(*) AS n, min({_PRICE}) AS min_price, max({_PRICE}) AS max_price, round(avg({_PRICE}), 2) AS avg_price"
_rounded = lambda df: df.withColumn("avg_price", F.round("avg_price", 2))
add("a03_price_stats", on_listings(lambda df: _rounded(stats.price_stats(df))), f"{_L} SELECT {_STATS} FROM listings WHERE {_PRICE} > 0")
add("a04_summary", on_listings(lambda df: _rounded(stats.price_stats(df, priced_only=False))), f"{_L} SELECT {_STATS} FROM listings")
add("a05_make", on_listings(stats.count_by_make), f"{_L} SELECT make, count(*) AS n FROM listings GROUP BY make")
add("a06_drivetrain", on_listings(stats.count_by_drivetrain), f"{_L} SELECT coalesce(nullif(drivetrain, ''), 'Unknown') AS drivetrain, count(*) AS n FROM listings GROUP BY 1")
add("a07_shares", on_listings(stats.shares), f"{_L} SELECT count(*) AS n, count_if({_ELECTRIC}) AS electric, round(100 * count_if({_ELECTRIC}) / count(*), 1) AS electric_percent, count_if(new_used = 'new') AS new, round(100 * count_if(new_used = 'new') / count(*), 1) AS new_percent FROM listings")
add("a09_pass_rate", on_listings(lambda df: stats.pass_rate(df, P.price() <= 60000)), f"{_L} SELECT count(*) AS n, count_if({_PRICE} <= 60000) AS passed, round(100 * count_if({_PRICE} <= 60000) / count(*), 1) AS percent FROM listings")
add("a11_progress", lambda spark, d: stats.progress(listings(spark, d), table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_name").alias("name"))), f"{_L} SELECT (SELECT count(DISTINCT s_name) FROM supplier WHERE s_acctbal > 0) AS completed, (SELECT count(*) FROM listings) AS listings")
add("a12_by_dealer", on_listings(stats.count_by_dealer), f"{_L} SELECT dealer_name, count(*) AS n FROM listings GROUP BY 1")
add("o02_top_makes", on_listings(lambda df: stats.count_by_make(df, 3)), f"{_L} SELECT make, count(*) AS n FROM listings GROUP BY make ORDER BY n DESC, make LIMIT 3")
add("o04_sample", on_listings(lambda df: stats.sample(df, ["ord"], 3).select(*KEYS)), f"{_L} SELECT {_KEYS} FROM listings ORDER BY ord LIMIT 3")
add("o05_first_items", on_listings(lambda df: df.select(*KEYS, stats.first_items("features", 1).alias("items"))), f"{_L} SELECT {_KEYS}, features[1:1] AS items FROM listings")
add("o06_page_numbers", lambda spark, d: spark.range(1).select(F.explode(F.sequence(F.lit(2), F.lit(50))).alias("n")).select("n", F.concat(F.lit("/inventory?page="), "n").alias("url")), "SELECT n::INT AS n, concat('/inventory?page=', n) AS url FROM range(2, 51) t(n)")
add("j2_dealer_stamp", lambda spark, d: lookups.stamp_dealer(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dealer_id")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("https://x.net").alias("website"), F.lit("Vancouver (Washington side)").alias("city"))), "SELECT l_orderkey, l_linenumber, l_suppkey AS dealer_id, s_name AS dealer_name, 'https://x.net' AS dealer_website, 'Vancouver' AS dealer_location_city, 'WA' AS dealer_location_state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
add("l1_dealer_by_name", lambda spark, d: lookups.dealer_by_name(table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name")), "R#00000000"), "SELECT s_suppkey AS ord, s_name AS name FROM supplier WHERE lower(s_name) LIKE '%r#00000000%' ORDER BY 1 LIMIT 1")
add("l2_dealers_by_city", lambda spark, d: lookups.dealers_by_city(table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.col("n_name").alias("city")), "Tion_1"), "SELECT s_name AS name, n_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE lower(n_name) LIKE '%tion_1%'")

# Extraction from rendered texts.


def _texts(spark: SparkSession, d: str, **cols: Column) -> DataFrame:
    return rendered(spark, d).select(*KEYS, *[c.alias(n) for n, c in cols.items()])


def _first(pattern: str, column: str = "body", group: int = 1) -> str:
    return f"nullif(trim(regexp_extract({column}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})), '')"


_PATTERNS = {
    "x01_vin": patterns.VIN, "x02_price": patterns.PRICE, "x03_mileage": patterns.MILEAGE, "x04_stock": patterns.STOCK, "x05_condition": patterns.CONDITION, "x06_availability": patterns.AVAILABILITY, "x07_body_label": patterns.BODY_STYLE_LABEL, "x08_body_value": patterns.BODY_STYLE_VALUE, "x09_exterior": patterns.EXTERIOR_COLOR, "x10_interior": patterns.INTERIOR_COLOR, "x11_transmission": patterns.TRANSMISSION, "x12_engine": patterns.ENGINE, "x13_fuel_label": patterns.FUEL_LABEL, "x14_fuel_value": patterns.FUEL_VALUE, "x15_drivetrain": patterns.DRIVETRAIN_VALUE, "x16_drivetrain_label": patterns.DRIVETRAIN_LABEL,
}
for _name, _pattern in _PATTERNS.items():
    add(_name, lambda spark, d, p=_pattern: _texts(spark, d, value=text.first_group("body", p)), f"{_R} SELECT {_KEYS}, {_first(_pattern)} AS value FROM rendered")

_DRIVE = " ".join(f"WHEN contains(t, '{w}') THEN '{c}'" for w, c in patterns.DRIVETRAINS)


def _drive_sql(pattern: str) -> str:
    raw = f"replace(lower({_first(pattern)}), '-', ' ')"
    return f"(SELECT CASE {_DRIVE} END FROM (SELECT {raw} AS t))"


def _fuel_sql(raw: str) -> str:
    return f"(SELECT CASE WHEN contains(t, 'ev') OR contains(t, 'electric') THEN CASE WHEN contains(t, 'plug-in') OR contains(t, 'phev') THEN 'phev' ELSE 'electric' END WHEN contains(t, 'hybrid') THEN CASE WHEN contains(t, 'plug-in') OR contains(t, 'phev') THEN 'phev' ELSE 'hybrid' END WHEN contains(t, 'gas') THEN 'gasoline' WHEN contains(t, 'diesel') THEN 'diesel' END FROM (SELECT lower({raw}) AS t))"


_CONDITION = f"(SELECT CASE WHEN t IS NULL THEN 'new' WHEN contains(t, 'certified') OR contains(t, 'cpo') THEN 'cpo' WHEN contains(t, 'used') OR contains(t, 'pre-owned') THEN 'used' ELSE 'new' END FROM (SELECT lower({_first(patterns.CONDITION)}) AS t))"
_STATUS = f"(SELECT CASE WHEN regexp_matches(t, 'transit|way|arriving|coming') THEN 'in_transit' WHEN contains(t, 'sold') THEN 'sold' WHEN contains(t, 'reserved') THEN 'reserved' WHEN regexp_matches(t, 'stock|available') THEN 'available' END FROM (SELECT lower({_first(patterns.AVAILABILITY)}) AS t))"
_INT = f"CAST(trunc(TRY_CAST(replace({_first(patterns.PRICE)}, ',', '') AS DOUBLE)) AS BIGINT)"
_VINS = f"upper({_first(patterns.VIN)})"
for _name, _make, _sql in (
    ("x17_ev_words", lambda: {"ev": N.names_electric(F.col("body"))}, f"regexp_matches(body, '{patterns.ELECTRIC}') AS ev"),
    ("x18_digits_price", lambda: {"price": N.digits_to_price(F.col("body"))}, "coalesce(TRY_CAST(regexp_replace(body, '[^0-9.]', '', 'g') AS DOUBLE), 0) AS price"),
    ("x18_digits_price_match", lambda: {"price": N.digits_to_price(text.first_group("body", patterns.PRICE))}, f"coalesce(TRY_CAST(regexp_replace({_first(patterns.PRICE)}, '[^0-9.]', '', 'g') AS DOUBLE), 0) AS price"),
    ("x19_year", lambda: {"year": X.year_of(F.col("body"), YEAR)}, f"coalesce(CAST(nullif(regexp_extract(body, '{patterns.YEAR}', 1), '') AS INT), {YEAR}) AS year"),
    ("x23_vin_cascade", lambda: {"vin": X.vin(F.col("body"))}, f"{_VINS} AS vin"),
    ("x25_mileage", lambda: {"mileage": X.mileage(F.col("body"))["value"]}, f"CAST(replace({_first(patterns.MILEAGE)}, ',', '') AS INT) AS mileage"),
    ("x27_condition", lambda: {"condition": X.new_used(F.col("body"))}, f"{_CONDITION} AS condition"),
    ("x28_fuel", lambda: {"fuel": X.fuel_type(F.col("body"))}, f"coalesce({_fuel_sql(_first(patterns.FUEL_LABEL))}, {_fuel_sql(_first(patterns.FUEL_VALUE))}, CASE WHEN regexp_matches({_first(patterns.ENGINE)}, '{patterns.ELECTRIC}') THEN {_fuel_sql(_first(patterns.ENGINE))} END) AS fuel"),
    ("x29_availability", lambda: {"status": X.availability(F.col("body"))}, f"{_STATUS} AS status"),
    ("x30_colors", lambda: {"exterior": X.color(F.col("body"), "exterior"), "interior": X.color(F.col("body"), "interior")}, f"{_first(patterns.EXTERIOR_COLOR)} AS exterior, {_first(patterns.INTERIOR_COLOR)} AS interior"),
    ("x31_drivetrain", lambda: {"drivetrain": X.drive(F.col("body"))}, f"coalesce({_drive_sql(patterns.DRIVETRAIN_LABEL)}, {_drive_sql(patterns.DRIVETRAIN_VALUE)}) AS drivetrain"),
    ("x33_body_style", lambda: {"body_style": X.body_style(F.col("body"))}, f"coalesce({_first(patterns.BODY_STYLE_LABEL)}, {_first(patterns.BODY_STYLE_VALUE)}) AS body_style"),
    ("n01_drivetrain", lambda: {"drivetrain": N.drivetrain(text.first_group("body", patterns.DRIVETRAIN_VALUE))}, f"{_drive_sql(patterns.DRIVETRAIN_VALUE)} AS drivetrain"),
    ("n02_price_int", lambda: {"price": N.price_to_int(text.first_group("body", patterns.PRICE))}, f"{_INT} AS price"),
    ("n03_fuel", lambda: {"fuel": N.fuel(text.first_group("body", patterns.FUEL_LABEL))}, f"{_fuel_sql(_first(patterns.FUEL_LABEL))} AS fuel"),
    ("n04_condition", lambda: {"condition": N.condition(text.first_group("body", patterns.CONDITION))}, f"{_CONDITION} AS condition"),
    ("n05_ev_hint", lambda: {"hint": N.hints_electric(F.col("title"))}, "regexp_matches(lower(title), 'electric|ev|battery|plug-in|plugin|tesla|rivian|lucid|zero.emission') AS hint"),
    ("n06_vin_valid", lambda: {"ok": N.is_vin(text.first_group("body", r"VIN: (\S+)"))}, "coalesce(regexp_full_match(nullif(regexp_extract(body, 'VIN: (\\S+)', 1), ''), '[A-HJ-NPR-Z0-9]{17}'), false) AS ok"),
    ("x20_title", lambda: {"year": X.title_parts(F.col("title"))["year"], "make": X.title_parts(F.col("title"))["make"], "model": X.title_parts(F.col("title"))["model"]}, "CAST(split_part(title, ' ', 1) AS INT) AS year, split_part(title, ' ', 2) AS make, nullif(array_to_string(string_split(title, ' ')[3:], ' '), '') AS model"),
    ("x21_make_model", lambda: {"make": X.make_model(F.col("body"))["make"], "model": X.make_model(F.col("body"))["model"]}, f"{_first(patterns.MAKE_MODEL)} AS make, {_first(patterns.MAKE_MODEL, group=2)} AS model"),
):
    add(_name, lambda spark, d, m=_make: _texts(spark, d, **m()), f"{_R} SELECT {_KEYS}, {_sql} FROM rendered")
add("x22_page_prices", lambda spark, d: rendered(spark, d).select(*KEYS, X.text_prices(F.col("body")).alias("p")).select(*KEYS, "p.*"))
add("w1_keywords", lambda spark, d: spark.sql("SELECT explode(array('vin', 'price', 'other')) AS field").select("field", F.size(N.keywords(F.col("field"))).alias("n")), "SELECT * FROM (VALUES ('vin', 3), ('price', 10), ('other', 0)) t(field, n)")
add("w2_keyword", lambda spark, d: table(spark, d, "documents").select("doc_id", N.has_keyword(F.col("text"), "fuel_type").alias("any_case"), N.has_keyword(F.col("text"), "condition", True).alias("exact")), "SELECT doc_id, regexp_matches(lower(text), 'fuel|engine|hybrid|electric|ev') OR contains(lower(text), 'phev') AS any_case, regexp_matches(text, 'Condition|New|Used|Pre-Owned|CPO') AS exact FROM documents")

# Pages.

_TAGLESS = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g')"
_TEXT = f"replace(replace(replace(replace(replace(replace(replace({_TAGLESS}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), chr(160), ' '), '&amp;', '&')"
add("h2_page_text", lambda spark, d: table(spark, d, "pages").select("page_id", H.page_text("html").alias("text")), f"SELECT page_id, {_TEXT} AS text FROM pages")
add("h10_links", lambda spark, d: table(spark, d, "pages").select("page_id", F.explode(H.links("html")).alias("href")), "SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\shref=\"([^\"]*)\"', 1)) AS href FROM pages")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.page_facts("html", "url", "url").alias("f"))


add("h5_page_facts", lambda spark, d: _facts(spark, d).select("page_id", "f.heading", F.size("f.images").alias("images"), "f.description", F.size("f.features").alias("features"), F.length("f.text").alias("chars")))
add("h9_inventory_page", lambda spark, d: _facts(spark, d).select("page_id", "f.inventory"))
add("h10_pagination", lambda spark, d: table(spark, d, "pages").select("page_id", F.explode(H.pagination("html", "url")).alias("url")))
add("h4_vehicle_cards", lambda spark, d: pages_plan.summaries(table(spark, d, "pages").withColumn("base", F.col("url"))))
add("h1_json_ld", lambda spark, d: _facts(spark, d).select("page_id", F.try_variant_get(H.json_ld(F.col("f.json_ld")), "$.fuelType", "string").alias("fuel")))


def _chain(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All pages, each pointing to the page 7 ids further, in a cycle of 50."""
    pages = table(spark, d, "pages")
    other = pages.select(F.col("page_id").alias("o"), F.col("url").alias("next_url"))
    edges = pages.join(other, F.floor(F.col("page_id") / 50) * 50 + (F.col("page_id") + 7) % 50 == F.col("o")).select("url", "next_url")
    return pages.select(F.col("page_id").alias("id"), "url"), edges


def h11(spark: SparkSession, d: str) -> DataFrame:
    starts, edges = _chain(spark, d)
    return pages_plan.follow(starts, edges)


add(
    "h11_next_closure",
    h11,
    "WITH RECURSIVE edges AS (SELECT p.url, min(o.url) AS next_url FROM pages p JOIN pages o ON p.page_id // 50 * 50 + (p.page_id + 7) % 50 = o.page_id WHERE p.url <> o.url GROUP BY p.url), chain AS (SELECT page_id AS id, 0 AS level, url, [url] AS seen FROM pages UNION ALL SELECT id, level + 1, next_url, list_append(seen, next_url) FROM chain JOIN edges USING (url) WHERE level < 50 AND NOT list_contains(seen, next_url)) SELECT id, level, url FROM chain WHERE level > 0",
)
# The real operator: every page, the default of 50 steps, links read from html. No SQL: it cannot read them.
add("h11_next_closure_all", lambda spark, d: pages_plan.next_closure(table(spark, d, "pages").select(F.col("page_id").alias("id"), "url"), table(spark, d, "pages")))


def _sites(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://d"), F.col("s_suppkey").cast("string")).alias("website"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("https://known/new")).alias("new_inventory_url"))


_PATHS = ", ".join(f"'{p}'" for p in (*pages_plan.INVENTORY_PATHS, ""))
add(
    "h12_candidates",
    lambda spark, d: pages_plan.inventory_candidates(_sites(spark, d)).select("id", "pos", "url"),
    f"SELECT s_suppkey AS id, 0 AS pos, 'https://known/new' AS url FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, i - 1, concat('https://d', s_suppkey, [{_PATHS}][i]) FROM supplier, range(1, 10) t(i) WHERE s_suppkey % 3 <> 0",
)

# Robots.


def _rules(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "pages").select(robots.url_host("url").alias("host")).distinct()
    return robots.parse_rules(hosts.withColumn("robots", F.lit(ROBOTS)))


_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
add("r1_rules", lambda spark, d: _rules(spark, d).groupBy("agent", "allow", "path").agg(F.countDistinct("host").alias("hosts")), "SELECT a AS agent, l AS allow, p AS path, (SELECT count(DISTINCT regexp_extract(url, '^https?://([^/?#]*)', 1)) FROM pages) AS hosts FROM (VALUES ('bot', false, '/*7'), ('crawler', false, '/*7'), ('bot', true, '/*17'), ('crawler', true, '/*17'), ('*', false, '/page/*3$'), ('*', false, '/x(')) t(a, l, p)")
add(
    "r2_robots_allowed",
    lambda spark, d: robots.verdicts(table(spark, d, "pages").select("page_id", "url", robots.url_host("url").alias("host")), _rules(spark, d), "Bot").select("page_id", "allowed"),
    f"SELECT page_id, CASE WHEN regexp_matches({_PATH}, '^/.*17.*') THEN true WHEN regexp_matches({_PATH}, '^/.*7.*') THEN false WHEN regexp_matches({_PATH}, '^/page/.*3$') OR starts_with({_PATH}, '/x(.') THEN false ELSE true END AS allowed FROM pages",
)
add("r4_disallowed", lambda spark, d: robots.disallowed_paths(_rules(spark, d), "bot").select("path").distinct(), "SELECT * FROM (VALUES ('/*7'), ('/page/*3$'), ('/x(')) t(path)")
add("f23_allowed_pages", lambda spark, d: robots.allowed_pages(table(spark, d, "pages"), _rules(spark, d)).select("page_id"), f"SELECT page_id FROM pages WHERE NOT (regexp_matches({_PATH}, '^/page/.*3$') OR starts_with({_PATH}, '/x(.'))")

# Sinks and the whole run.

add(
    "k3_csv_projection",
    on_listings(lambda df: sinks.csv_row(df).select("vehicle_url", "year", "trim", "drivetrain", "vin", "mileage", "description", "features", "images", "scraped_at")),
    f"{_L} SELECT vehicle_url, CAST(year AS STRING) AS year, coalesce(trim, '') AS trim, coalesce(drivetrain, '') AS drivetrain, coalesce(vin, '') AS vin, coalesce(CAST(mileage AS STRING), '') AS mileage, coalesce(replace(description, chr(10), ' '), '') AS description, array_to_string(features, '; ') AS features, array_to_string(images, '; ') AS images, strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at FROM listings",
)


def run(spark: SparkSession, d: str) -> DataFrame:
    """Entry C: validated, deduplicated, filtered listings."""
    return run_listings(listings(spark, d), ["ord"], FilterSpec(max_price=90000, max_mileage=400), as_of_year=YEAR).filtered.select(*KEYS)


_VALID = _LAX.replace("SELECT l.*,", f"SELECT l.*,").replace("FROM listings l LEFT JOIN", f"FROM (SELECT * FROM listings WHERE {_OK}) l LEFT JOIN")
add(
    "e_run_listings",
    run,
    f"{_VALID}{_WIN.replace('FROM listings)', 'FROM judged WHERE len(errors) = 0)')} SELECT {_KEYS} FROM f JOIN judged USING ({_KEYS}) WHERE {_ELECTRIC} AND {_PRICE} <= 90000 AND coalesce(in_stock_status, '') <> 'sold' AND new_used = 'new' AND CASE WHEN mileage IS NULL THEN year >= {YEAR - 1} ELSE mileage <= 400 END",
)
