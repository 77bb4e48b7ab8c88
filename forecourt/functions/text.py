"""Text helpers with the whitespace rules of the extraction layer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once, however often the expression names it.

    The value is the one element of an array, the expression a lambda over it: a variable is
    read again, a plain column would be copied into every place that names it.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: str | Column) -> Column:
    """Without white space at either end (all white space, not only blanks)."""
    return F.regexp_replace(_column(c), r"(?U)^\s+|\s+$", "")


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(_column(c), F.lit(""))


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def contains_any(c: Column, needles) -> Column:
    """Whether a text contains one of the needles; null for a null text."""
    out = F.lit(False)
    for needle in needles:
        out = out | c.contains(needle)
    return out


def first_group(c: str | Column, pattern: str, group: int = 1) -> Column:
    """The leftmost match's group, stripped; null without a match or if it is empty."""
    return once(strip(F.regexp_extract(_column(c), pattern, group)), lambda found: F.when(found != "", found))
