"""Data-quality rules (V1-V5): errors and warnings of a listing, and their report (A1, A2, O1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_electric, price
from ..functions.normalize import is_vin
from ..functions.text import contains_any, false_if_null, once

# Fixed values of the rules.
ELECTRIC_MAKES = ("Tesla", "Rivian", "Lucid", "Polestar", "BYD", "Nio", "Xpeng", "Fisker", "Lordstown", "Canoo", "Faraday Future")
ELECTRIC_MODELS = (
    "Model S", "Model 3", "Model X", "Model Y", "R1T", "R1S", "Air", "Polestar 2", "Polestar 3", "Polestar 4", "Mustang Mach-E", "F-150 Lightning", "Bolt", "Bolt EUV", "Blazer EV", "Equinox EV", "Silverado EV", "IONIQ 5", "IONIQ 6", "Kona Electric", "EV6", "EV9", "Niro EV", "Ariya", "ID.4", "ID.Buzz", "e-tron", "Q4 e-tron", "e-tron GT", "EQE", "EQS", "EQB", "EQC", "iX", "i4", "iX1", "i5", "i7", "Lyriq", "bZ4X", "Solterra", "Prologue", "ZDX", "RZ",
)
MODEL_WORDS = ("electric", "ev", "e-tron", "eq", "id.", "i4", "ix", "ioniq", "mach-e", "lightning", "bolt", "leaf")
FUEL_WORDS = ("electric", "ev", "bev", "phev", "plug")
OTHER_FUELS = ("gasoline", "gas", "diesel", "flex", "e85")
PLACEHOLDERS = ("test", "example", "sample", "placeholder", "demo", "xxx", "zzz", "abc123", "000000", "999999")
PLACEHOLDER_FIELDS = ("make", "model", "trim", "dealer_name", "vin", "stock_number", "exterior_color")
#: make, model, usual lowest and highest price.
PRICE_RANGES = (
    ("Tesla", "Model 3", 35000, 55000), ("Tesla", "Model Y", 40000, 65000), ("Tesla", "Model S", 75000, 120000), ("Tesla", "Model X", 80000, 120000),
    ("Hyundai", "IONIQ 5", 40000, 60000), ("Hyundai", "IONIQ 6", 42000, 62000), ("Hyundai", "Kona Electric", 33000, 45000),
    ("Kia", "EV6", 42000, 65000), ("Kia", "EV9", 55000, 75000), ("Kia", "Niro EV", 39000, 50000),
    ("Ford", "Mustang Mach-E", 40000, 65000), ("Ford", "F-150 Lightning", 50000, 95000),
    ("Chevrolet", "Bolt", 25000, 35000), ("Chevrolet", "Bolt EUV", 28000, 38000), ("Chevrolet", "Blazer EV", 45000, 65000), ("Chevrolet", "Equinox EV", 30000, 50000),
)
LOW_SHARE, HIGH_SHARE = 0.6, 1.3


def likely_electric() -> Column:
    """V2: an electric make or model, a model or fuel with an electric word in it, or an electric fuel."""
    return (
        false_if_null(F.col("make").isin(*ELECTRIC_MAKES))
        | false_if_null(F.col("model").isin(*ELECTRIC_MODELS))
        | once(F.lower("model"), lambda model: false_if_null(contains_any(model, MODEL_WORDS)))
        | once(F.lower("fuel_type"), lambda fuel: false_if_null(contains_any(fuel, FUEL_WORDS)))
        | is_electric()
    )


def is_placeholder() -> Column:
    """V4: whether a field holds a word of test data."""
    # No word has a line break, so none is found across two fields; absent fields are left out.
    fields = F.concat_ws("\n", *PLACEHOLDER_FIELDS)
    return once(F.lower(fields), lambda text: contains_any(text, PLACEHOLDERS))


def _dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def with_price_range(listings: DataFrame) -> DataFrame:
    """Add __low and __high, the widened usual price range of (make, model); null if unknown.

    The table has one row per known model, so it is broadcast.
    """
    spark = listings.sparkSession
    table = spark.createDataFrame([(make, model, low * LOW_SHARE, high * HIGH_SHARE) for make, model, low, high in PRICE_RANGES], "__make string, __model string, __low double, __high double")
    return listings.join(F.broadcast(table), (F.col("make") == F.col("__make")) & (F.col("model") == F.col("__model")), "left").drop("__make", "__model")


def price_range_warning(cost: Column | None = None) -> Column:
    """V3: a warning if the price lies outside the model's range; reads __low and __high."""
    cost = price() if cost is None else cost
    typical = F.concat(F.lit(" for "), "make", F.lit(" "), "model", F.lit(" (typical: "), _dollars(F.col("__low")), F.lit("-"), _dollars(F.col("__high")), F.lit(")"))
    return F.when((cost > 0) & (cost < F.col("__low")), F.concat(F.lit("Price "), _dollars(cost), F.lit(" seems low"), typical)).when(
        (cost > 0) & (cost > F.col("__high")), F.concat(F.lit("Price "), _dollars(cost), F.lit(" seems high"), typical)
    )


def with_shared(listings: DataFrame) -> DataFrame:
    """Add __cost, __electric, __other_fuel and __placeholder, which several rules read.

    They leave a generator of one row: above it they are plain columns, computed once.
    """
    other = once(F.lower("fuel_type"), lambda fuel: contains_any(fuel, OTHER_FUELS) & ~contains_any(fuel, ("hybrid", "phev")))
    shared = F.struct(price().alias("__cost"), likely_electric().alias("__electric"), other.alias("__other_fuel"), is_placeholder().alias("__placeholder"))
    return listings.select("*", F.inline_outer(F.array(shared)))


def _error_rules(as_of_year: int, strict: bool) -> list[Column]:
    """V1a, V1b, V1d, V1e: each rule's message, null where it holds; reads what ``with_shared`` adds."""
    c, cost = F.col, F.col("__cost")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    missing = lambda name: c(name).isNull() | (c(name) == "")
    unlisted = lambda name: missing(name) | (c(name) == "Unknown")
    no_http = lambda name: ~false_if_null(c(name).startswith("http"))
    return [
        F.when(unlisted("make"), "Missing or unknown make"),
        F.when(unlisted("model"), "Missing or unknown model"),
        F.when(c("year") < 2015, text("Year too old for electric vehicle: ", c("year").cast("string"))).when(c("year") > as_of_year + 2, text("Year too far in future: ", c("year").cast("string"))),
        (F.when(cost <= 0, "Missing or zero price") if strict else F.when(cost <= 0, F.lit(None).cast("string")))
        .when(cost < 5000, text("Suspiciously low price: ", _dollars(cost)))
        .when((cost > 250000) & ~F.isnan(cost), text("Price exceeds maximum for target vehicles: ", _dollars(cost))),
        F.when(no_http("vehicle_url"), "Invalid or missing vehicle URL"),
        F.when(missing("dealer_name"), "Missing dealer name"),
        F.when(no_http("dealer_website"), "Invalid dealer website"),
        F.when(~c("__electric"), text("Vehicle does not appear to be electric: ", c("year").cast("string"), " ", F.coalesce("make", F.lit("None")), " ", F.coalesce("model", F.lit("None")))),
        F.when(c("__other_fuel"), text("Non-electric fuel type: ", c("fuel_type"))),
        F.when(c("mileage") > 300000, text("Extremely high mileage: ", F.format_number("mileage", 0))),
        F.when(c("mileage") < 0, text("Negative mileage: ", c("mileage").cast("string"))),
        F.when(c("__placeholder"), "Appears to be test/placeholder data"),
    ]


def errors(as_of_year: int, strict: bool = False) -> Column:
    """Array of error messages, in rule order."""
    return F.array_compact(F.array(*_error_rules(as_of_year, strict)))


def warnings(strict: bool = False) -> Column:
    """Array of warning messages, in rule order; reads __low, __high and what ``with_shared`` adds."""
    c = F.col
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    no_vin = c("vin").isNull() | (c("vin") == "")
    rules = [
        F.lit(None).cast("string") if strict else F.when(c("__cost") <= 0, "Missing price - may be 'call for price' listing"),
        F.when(~no_vin & ~is_vin(c("vin")), text("Invalid VIN format: ", c("vin"))),
        F.when(no_vin, "Missing VIN (harder to verify uniqueness)") if strict else F.lit(None).cast("string"),
        F.when((c("new_used") == "new") & (c("mileage") > 500), text("High mileage for new car: ", c("mileage").cast("string"))),
        F.when(~false_if_null(c("new_used").isin("new", "used", "cpo")), text("Unusual condition value: ", F.coalesce("new_used", F.lit("None")))),
        price_range_warning(c("__cost")),
    ]
    return F.array_compact(F.array(*rules))


def validate(listings: DataFrame, *, as_of_year: int, strict: bool = False) -> DataFrame:
    """V1: add is_valid (no error) and issues (errors, then warnings with a prefix).

    The verdicts leave a generator of one row: above it they are plain columns, computed once
    per row, which the optimizer neither copies into filters nor infers constraints from.
    """
    found = F.struct(errors(as_of_year, strict).alias("__errors"), F.transform(warnings(strict), lambda w: F.concat(F.lit("WARNING: "), w)).alias("__warnings"))
    made = with_shared(with_price_range(listings)).select(*listings.columns, F.inline_outer(F.array(found)))
    return made.select(*listings.columns, (F.size("__errors") == 0).alias("is_valid"), F.concat("__errors", "__warnings").alias("issues"))


def valid_only(listings: DataFrame, *, as_of_year: int, strict: bool = False) -> DataFrame:
    """the rows without an error. No message is composed; a row is judged up to its first error."""
    return with_shared(listings).where(F.coalesce(*_error_rules(as_of_year, strict)).isNull()).select(*listings.columns)


def validation_counts(validated: DataFrame) -> DataFrame:
    """A1: total, valid and invalid rows, with percentages to one decimal."""
    n = F.count("*")
    percent = lambda k: F.round(100 * k / F.nullif(n, F.lit(0)), 1)
    valid, invalid = F.count_if("is_valid"), F.count_if(~F.col("is_valid"))
    return validated.agg(n.alias("total"), valid.alias("valid"), invalid.alias("invalid"), percent(valid).alias("valid_percent"), percent(invalid).alias("invalid_percent"))


def issue_kind(issue: Column) -> Column:
    """A message without its amounts and four-digit numbers."""
    return F.regexp_replace(F.regexp_replace(issue, r"\$[\d,]+", r"\$X"), r"\d{4}", "YYYY")


def issue_histogram(validated: DataFrame) -> DataFrame:
    """A2: messages of invalid rows by kind."""
    found = validated.select(F.explode_outer(F.when(~F.col("is_valid"), F.col("issues"))).alias("issue")).where("issue is not null")
    return found.select(issue_kind(F.col("issue")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def top_issues(validated: DataFrame, n: int = 10) -> DataFrame:
    """O1, V5: the most frequent kinds, ties by name."""
    return issue_histogram(validated).orderBy(F.desc("n"), "issue").limit(n)
