"""Normalisation of extracted texts (N1-N6) and keyword tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import DRIVETRAINS, ELECTRIC, EV_HINTS, KEYWORDS
from .text import contains_any, false_if_null, once, strip


def drivetrain(raw: Column) -> Column:
    """AWD, FWD, RWD or 4WD by the first known word that the text contains.

    No word is part of another one, so a text that is a word contains no earlier one: whole
    matches need no search of their own.
    """
    table = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(code).alias("code")) for word, code in DRIVETRAINS])
    plain = F.replace(F.lower(raw), F.lit("-"), F.lit(" "))
    return once(plain, lambda text: F.get(F.filter(table, lambda known: text.contains(known["word"])), F.lit(0))["code"])


def price_to_int(raw: Column) -> Column:
    """Whole dollars of a number with commas; null if it is none."""
    return F.replace(strip(raw), F.lit(","), F.lit("")).try_cast("double").try_cast("long")


def digits_to_price(raw: Column) -> Column:
    """All digits and points of a text as one number; 0 if they are none."""
    return F.coalesce(F.regexp_replace(raw, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def fuel(raw: Column) -> Column:
    """Electric, phev, hybrid, gasoline, diesel or null, by contained words."""

    def named(text: Column) -> Column:
        plug = contains_any(text, ("plug-in", "phev"))
        return (
            F.when(contains_any(text, ("electric", "ev")), F.when(plug, "phev").otherwise("electric"))
            .when(text.contains("hybrid"), F.when(plug, "phev").otherwise("hybrid"))
            .when(text.contains("gas"), "gasoline")
            .when(text.contains("diesel"), "diesel")
        )

    return once(F.lower(raw), named)


def condition(raw: Column) -> Column:
    """Cpo, used or new; new for nothing (and for "pre owned" with a blank)."""
    named = lambda text: F.when(contains_any(text, ("certified", "cpo", "c.p.o")), "cpo").when(contains_any(text, ("used", "pre-owned")), "used").otherwise("new")
    return once(F.lower(raw), named)


def hints_electric(raw: Column) -> Column:
    """Whether a text contains an electric hint."""
    return once(F.lower(raw), lambda text: false_if_null(contains_any(text, EV_HINTS)))


def is_vin(raw: Column) -> Column:
    """17 capitals (without I, O, Q) and digits."""
    return false_if_null((F.length(raw) == 17) & raw.rlike("^[A-HJ-NPR-Z0-9]{17}$"))


def names_electric(raw: Column) -> Column:
    """Whether an electric word stands in a text."""
    return false_if_null(raw.rlike(ELECTRIC))


def keywords(field: Column) -> Column:
    """The keywords of a field; empty for an unknown one."""
    table = F.create_map(*[x for name, words in KEYWORDS.items() for x in (F.lit(name), F.array(*map(F.lit, words)))])
    return F.coalesce(F.try_element_at(table, field), F.array().cast("array<string>"))


def has_keyword(text: Column, field: str, case_sensitive: bool = False) -> Column:
    """Whether a text contains a keyword of a field."""
    words = KEYWORDS.get(field, ())
    if case_sensitive:
        return false_if_null(contains_any(text, words))
    low = [word.lower() for word in words]
    return once(F.lower(text), lambda t: false_if_null(contains_any(t, low)))

