"""Extraction cascades (X19-X33, H5): columns over a page's text and facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .columns import clean_city, state_of_city
from .html import json_ld, page_facts
from .normalize import condition, drivetrain, fuel, hints_electric, names_electric, price_to_int
from .text import blank_to_null, contains_any, first_group, once, strip


def year_of(text: Column, as_of_year: int) -> Column:
    """The first year of 1900 to 2099 in a text, else the given one."""
    return F.coalesce(F.regexp_extract(text, P.YEAR, 1).try_cast("int"), F.lit(as_of_year))


def title_parts(title: Column) -> Column:
    """struct(year, make, model, trim) of a title such as "2025 Hyundai IONIQ 5 SEL".

    The first year goes from the title, wherever it stands. A make is one that the title
    starts with (the first of the list), or the first later word that is one; the model is
    what follows that word (so the second word of a two-word make belongs to it); the trim
    is never told apart.
    """
    makes = F.array(*map(F.lit, P.MAKES))

    def parted(x: Column) -> Column:
        leading = F.when(F.size(x["words"]) > 0, F.get(F.filter(makes, lambda m: x["rest"].startswith(m)), F.lit(0)))
        place = F.array_position(F.transform(x["words"], lambda w: w.isin(*P.MAKES)), F.lit(True))
        return once(F.struct(x["year"].alias("year"), x["words"].alias("words"), leading.alias("leading"), place.cast("int").alias("place")), named)

    def named(x: Column) -> Column:
        words = x["words"]
        at = F.when(x["leading"].isNotNull(), F.lit(1)).when(x["place"] > 0, x["place"])
        make = F.coalesce(x["leading"], F.get(words, at - 1))
        model = F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ")
        return F.struct(x["year"].try_cast("int").alias("year"), make.alias("make"), blank_to_null(model).alias("model"), F.lit(None).cast("string").alias("trim"))

    def worded(x: Column) -> Column:
        words = F.filter(F.split(x["rest"], r"(?U)\s+"), lambda w: w != "")
        return once(F.struct(x["year"].alias("year"), x["rest"].alias("rest"), words.alias("words")), parted)

    def dated(year: Column) -> Column:
        rest = F.when(year != "", strip(F.replace(title, year, F.lit("")))).otherwise(title)
        return once(F.struct(year.alias("year"), rest.alias("rest")), worded)

    return once(F.regexp_extract(title, P.YEAR, 1), dated)


def make_model(text: Column) -> Column:
    """struct(make, model) of the first make in a text and the letters and digits after it."""
    return F.struct(blank_to_null(F.regexp_extract(text, P.MAKE_MODEL, 1)).alias("make"), first_group(text, P.MAKE_MODEL, 2).alias("model"))


def vin(text: Column, labelled: Column | None = None) -> Column:
    """A VIN in the text; else a labelled value of 17 letters and digits."""
    found = F.upper(first_group(text, P.VIN))
    if labelled is None:
        return found
    plain = F.regexp_replace(F.upper(labelled), "[^A-Z0-9]", "")
    return F.coalesce(found, F.when(F.length(plain) == 17, plain))


def stock_number(text: Column, labelled: Column | None = None) -> Column:
    """X24."""
    found = first_group(text, P.STOCK)
    return found if labelled is None else F.coalesce(found, strip(F.regexp_replace(labelled, r"(?U)\s+", " ")))


def mileage_text(raw: Column) -> Column:
    """struct(value, unit) of a labelled mileage; kilometres if the text says so."""
    number = F.regexp_extract(F.replace(raw, F.lit(","), F.lit("")), r"(\d+(?:[.,]\d+)?)", 1).try_cast("double").try_cast("int")
    unit = F.when(number.isNotNull() & contains_any(F.lower(raw), ("km", "kilometer")), "km").otherwise("mi")
    return F.struct(number.alias("value"), unit.alias("unit"))


def mileage(text: Column, labelled: Column | None = None) -> Column:
    """struct(value, unit): a number before miles in the text, else the labelled one."""
    direct = F.struct(price_to_int(first_group(text, P.MILEAGE)).try_cast("int").alias("value"), F.lit("mi").alias("unit"))
    if labelled is None:
        return direct
    return once(direct, lambda found: F.when(found["value"].isNotNull() | labelled.isNull(), found).otherwise(mileage_text(labelled)))


def new_used(text: Column, title: Column | None = None, labelled: Column | None = None) -> Column:
    """By a condition word in the text, in the title, by the label; else new."""
    def known(raw):
        return once(raw, lambda found: F.when(found.isNotNull(), condition(found)))

    steps = [known(first_group(text, P.CONDITION))]
    if title is not None:
        low = F.lower(title)
        steps.append(known(first_group(title, P.CONDITION)))
        named = contains_any(low, [k.lower() for k in P.KEYWORDS["condition"]])
        steps.append(once(condition(title), lambda whole: F.when(named & (whole != "new"), whole)))
    if labelled is not None:
        steps.append(known(labelled))
    return F.coalesce(*steps, F.lit("new"))


def fuel_type(text: Column, structured: Column | None = None, labelled: Column | None = None, engines: Column | None = None) -> Column:
    """Structured data decides if it names a fuel at all; else label, word, engine, labelled value, engine elements."""

    def by_engine(engine: Column) -> Column:
        # An electric engine is final even if it gives no known fuel; so is a labelled value.
        rest = F.when(names_electric(engine), fuel(engine))
        if labelled is not None:
            rest = rest.when(labelled != "", fuel(labelled))
        if engines is not None:
            hit = F.get(F.filter(engines, lambda t: hints_electric(t) | names_electric(t)), F.lit(0))
            rest = rest.otherwise(fuel(hit))
        return rest

    out = once(text, lambda t: F.coalesce(fuel(first_group(t, P.FUEL_LABEL)), fuel(first_group(t, P.FUEL_VALUE)), once(first_group(t, P.ENGINE), by_engine)))
    return out if structured is None else F.when(structured.isNotNull(), fuel(structured)).otherwise(out)


def _status(raw: Column, coming: bool) -> Column:
    return once(F.lower(raw), lambda low: _status_of(low, coming))


def _status_of(low: Column, coming: bool) -> Column:
    return (
        F.when(contains_any(low, ("transit", "way", "arriving", "coming") if coming else ("transit", "way")), "in_transit")
        .when(low.contains("sold"), "sold")
        .when(low.contains("reserved"), "reserved")
        .when(contains_any(low, ("stock", "available")), "available")
    )


def availability(text: Column, labelled: Column | None = None, elements: Column | None = None) -> Column:
    """By a phrase in the text, the labelled value, or the first status element that says one."""
    steps = [_status(first_group(text, P.AVAILABILITY), True)]
    if labelled is not None:
        steps.append(_status(labelled, False))
    if elements is not None:
        steps.append(F.get(F.filter(F.transform(elements, lambda t: _status(t, False)), lambda s: s.isNotNull()), F.lit(0)))
    return F.coalesce(*steps)


def color(text: Column, side: str, labelled: Column | None = None, elements: Column | None = None) -> Column:
    """The labelled colour of a side ("exterior" or "interior")."""
    found = first_group(text, P.EXTERIOR_COLOR if side == "exterior" else P.INTERIOR_COLOR)
    if labelled is None or elements is None:
        return found
    short = side[:3] + "."
    outside = lambda t: contains_any(F.lower(t), ("exterior", "ext."))
    named = F.exists(elements, outside if side == "exterior" else lambda t: contains_any(F.lower(t), ("interior", short)) & ~outside(t))
    cleaned = F.replace(F.replace(labelled, F.lit(f"{side.capitalize()} Color"), F.lit("")), F.lit(f"{side[:3].capitalize()}. Color"), F.lit(""))
    return F.coalesce(found, F.when(named & F.lower(labelled).contains(side), strip(cleaned)))


def drive(text: Column) -> Column:
    """The labelled drivetrain if it is a known one, else a drivetrain word."""
    return once(text, lambda t: F.coalesce(drivetrain(first_group(t, P.DRIVETRAIN_LABEL)), drivetrain(first_group(t, P.DRIVETRAIN_VALUE))))


def transmission(text: Column) -> Column:
    """X32."""
    return first_group(text, P.TRANSMISSION)


def body_style(text: Column) -> Column:
    """Labelled, else a body style word."""
    return once(text, lambda t: F.coalesce(first_group(t, P.BODY_STYLE_LABEL), first_group(t, P.BODY_STYLE_VALUE)))


#: Fixed: the kinds of prices in the order in which they are tried, and the words around them.
PRICE_KINDS = (("msrp", "manufacturer", "sticker", "retail"), ("sale", "our price", "internet", "e-price", "dealer price", "special"), ("total", "final", "out the door", "otd"))
_AROUND = 50


def text_prices(text: Column) -> Column:
    """X22 over a text: struct(msrp, sale_price, total_price) by the words around each dollar amount.

    The text is split at its amounts. The 50 characters on either side of one are in the ends
    of the pieces next to it, so pieces are cut to their ends first and no place in the text
    is ever looked up: the work is linear in the text, in one pass over an array.
    """
    ends = lambda p: F.when(F.length(p) > 2 * _AROUND, F.concat(F.left(p, F.lit(_AROUND)), F.right(p, F.lit(_AROUND)))).otherwise(p)
    parts = F.struct(
        F.transform(F.split(text, P.PRICE, -1), ends).alias("between"),
        F.regexp_extract_all(text, F.lit(P.PRICE), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(P.PRICE), F.lit(1)).alias("number"),
    )

    def judged(x: Column) -> Column:
        """Amount and kind (0 to 2, null for none) of each match."""
        pairs = F.flatten(F.transform(x["between"], lambda p, i: F.array(p, F.coalesce(F.get(x["found"], i), F.lit("")))))

        def one(number: Column, i: Column) -> Column:
            # Element 2i + 1 of the pairs is the match; it has two characters at least, so 25 others bound 50.
            at, most = 2 * i + 1, _AROUND + 2
            before = F.array_join(F.slice(pairs, F.greatest(at - most, F.lit(0)) + 1, at - F.greatest(at - most, F.lit(0))), "")
            after = F.array_join(F.slice(pairs, at + 2, F.lit(most)), "")
            around = F.lower(F.concat(F.right(before, F.lit(_AROUND)), F.get(pairs, at), F.left(after, F.lit(_AROUND))))
            kind = once(around, lambda t: F.coalesce(*[F.when(contains_any(t, words), F.lit(k)) for k, words in enumerate(PRICE_KINDS)]))
            return F.struct(F.floor(F.replace(number, F.lit(","), F.lit("")).try_cast("double")).cast("double").alias("v"), kind.alias("kind"))

        return F.filter(F.transform(x["number"], one), lambda p: p["v"] > 0)

    def add(s: Column, p: Column) -> Column:
        is_sale = (p["kind"] == 1) | (p["kind"].isNull() & s["sale"].isNull())
        return F.struct(
            F.when(p["kind"] == 0, F.greatest(s["msrp"], p["v"])).otherwise(s["msrp"]).alias("msrp"),
            F.when(F.coalesce(is_sale, F.lit(False)), F.least(s["sale"], p["v"])).otherwise(s["sale"]).alias("sale"),
            F.when(p["kind"] == 2, p["v"]).otherwise(s["total"]).alias("total"),
        )

    none = F.lit(None).cast("double")
    start = F.struct(none.alias("msrp"), none.alias("sale"), none.alias("total"))
    return once(F.aggregate(once(parts, judged), start, add), lambda s: F.struct(s["msrp"].alias("msrp"), s["sale"].alias("sale_price"), F.coalesce(s["total"], s["sale"]).alias("total_price")))


def listings_of_pages(pages: DataFrame, *, as_of_year: int, scraped_at: Column, profile: str = "generic", only: Sequence[str] | None = None) -> DataFrame:
    """Listings from rows (url, html, dealer_name, dealer_website, city).

    A page is parsed once into facts; everything else is Spark expressions over these.
    Pages without make and model are left out, but for the rendered and template profiles;
    so are pages that cannot be read, which ``plans.pages.failed_pages`` lists (E4).
    ``only`` names the columns wanted, in the order of a listing: the others' cascades are
    neither planned nor computed. The rows are the same.
    """
    read = pages.select("url", "dealer_name", "dealer_website", "city", page_facts("html", "dealer_website", "url", profile).alias("f")).where("f.error IS NULL")
    value = lambda name: F.try_element_at(F.col("f.values"), F.lit(name))
    text = F.col("f.text")
    own = title_parts(F.col("f.heading"))
    parts = F.transform("f.names", title_parts)
    first_of = lambda name: F.get(F.filter(F.transform(parts, lambda p: p[name]), lambda v: v.isNotNull()), F.lit(0))
    step = read.withColumn("own", own)
    if only is None or not {"mileage", "mileage_units"}.isdisjoint(only):
        step = step.withColumn("miles", mileage(text, value("mileage")))
    if profile == "generic":
        whole = F.col("own.make").isNotNull() & F.col("own.model").isNotNull()
        step = step.withColumn("year", F.coalesce("own.year", F.when(~whole, first_of("year")))).withColumn("make", F.coalesce("own.make", first_of("make"))).withColumn("model", F.coalesce("own.model", first_of("model")))
        found = make_model(text)
        step = step.withColumn("make", F.coalesce("make", found["make"])).withColumn("model", F.coalesce("model", found["model"]))
    else:
        step = step.withColumns({n: F.col(f"own.{n}") for n in ("year", "make", "model")})
    located = profile != "template"
    # Made when asked for: a column that nobody wants costs nothing, in planning neither.
    columns = {
        "dealer_name": lambda: F.col("dealer_name"),
        "dealer_website": lambda: F.col("dealer_website"),
        "vehicle_url": lambda: F.col("url"),
        "year": lambda: F.coalesce("year", F.lit(as_of_year)),
        "make": lambda: F.coalesce("make", F.lit("Unknown")),
        "model": lambda: F.coalesce("model", F.lit("Unknown")),
        "trim": lambda: F.col("own.trim"),
        "new_used": lambda: new_used(text, F.col("f.title"), value("condition")),
        "fuel_type": lambda: fuel_type(text, F.try_variant_get(json_ld(F.col("f.json_ld")), "$.fuelType", "string"), value("fuel_type"), F.col("f.engines")),
        "drivetrain": lambda: drive(text),
        "transmission": lambda: transmission(text),
        "body_style": lambda: body_style(text),
        "msrp": lambda: F.col("f.prices.msrp"),
        "sale_price": lambda: F.col("f.prices.sale_price"),
        "total_price": lambda: F.col("f.prices.total_price"),
        "currency": lambda: F.lit("USD"),
        "price_note": lambda: F.lit(None).cast("string"),
        "vin": lambda: vin(text, value("vin")),
        "stock_number": lambda: stock_number(text, value("stock_number")),
        "mileage": lambda: F.col("miles.value"),
        "mileage_units": lambda: F.col("miles.unit"),
        "in_stock_status": lambda: availability(text, value("availability"), F.col("f.statuses")),
        "exterior_color": lambda: color(text, "exterior", value("colors"), F.col("f.colors")),
        "interior_color": lambda: color(text, "interior", value("colors"), F.col("f.colors")),
        "dealer_location_city": lambda: clean_city("city") if located else F.lit(None).cast("string"),
        "dealer_location_state": lambda: state_of_city("city") if located else F.lit(None).cast("string"),
        "description": lambda: F.col("f.description"),
        "features": lambda: F.col("f.features"),
        "images": lambda: F.col("f.images"),
        "scraped_at": lambda: scraped_at.cast("timestamp_ntz"),
    }
    # A generator of one row: what is built on a listing reads columns, not the cascades again.
    if only is not None and not columns.keys() >= set(only):
        raise ValueError(f"no columns of a listing: {sorted(set(only) - columns.keys())}")
    needed = columns if only is None else {n: c for n, c in columns.items() if n in only or profile == "generic" and n in ("make", "model")}
    out = step.select(F.inline_outer(F.array(F.struct(*[c().alias(n) for n, c in needed.items()]))))
    out = out if profile != "generic" else out.where("make != 'Unknown' or model != 'Unknown'")
    return out if only is None else out.select(*[n for n in columns if n in only])
