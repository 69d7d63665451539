"""Column helpers: small expressions that stay inside whole-stage codegen."""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_blank(value: Column | str) -> Column:
    """NULL or only spaces."""
    value = as_col(value)
    return value.isNull() | (F.trim(value) == "")


def is_filled(value: Column | str) -> Column:
    return ~is_blank(value)


def is_empty(value: Column | str) -> Column:
    """NULL or the empty string; spaces count as content."""
    value = as_col(value)
    return value.isNull() | (value == "")


def holds(predicate: Column) -> Column:
    """A predicate with SQL WHERE meaning: NULL counts as false."""
    return F.coalesce(predicate, F.lit(False))


def ratio(numerator: Column | str, denominator: Column | str, when_zero: float = 0.0) -> Column:
    """Double division with an explicit result for a zero or missing denominator."""
    num, den = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.when(F.coalesce(den, F.lit(0.0)) == 0.0, F.lit(float(when_zero))).otherwise(num / den)


def percent(numerator: Column | str, denominator: Column | str, when_zero: float = 0.0) -> Column:
    """Percentage rounded to two digits, with an explicit zero-denominator policy."""
    num, den = as_col(numerator).cast("double"), as_col(denominator).cast("double")
    return F.when(F.coalesce(den, F.lit(0.0)) == 0.0, F.lit(float(when_zero))).otherwise(
        F.round(num * 100.0 / den, 2)
    )


def tally(predicate: Column) -> Column:
    """Number of rows for which the predicate holds."""
    return F.count(F.when(predicate, 1))


def total(value: Column | str, digits: int = 2) -> Column:
    """Sum that is zero on no rows; rounded so that it does not depend on summation order."""
    return F.round(F.coalesce(F.sum(value), F.lit(0.0)), digits)


def whole(value: Column | str) -> Column:
    """Integer sum that is zero on no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def money_text(value: Column | str) -> Column:
    """Two fixed decimals; plain double text would switch to scientific notation."""
    return as_col(value).cast("decimal(18,2)").cast("string")


def say(template: str, **parts: Column | str) -> Column:
    """Fill ``{name}`` slots of a sentence with columns; a NULL part reads ``N/A``, so no sentence is lost."""
    pieces: list[Column] = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot:
            pieces.append(F.coalesce(as_col(parts.get(slot, slot)).cast("string"), F.lit("N/A")))
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """Minutes between two timestamps, counting minute boundaries crossed.

    Built from days, hours and minutes, so the session time zone plays no part.
    """
    start, end = as_col(start), as_col(end)
    return (
        F.datediff(end, start) * 1440 + (F.hour(end) - F.hour(start)) * 60 + (F.minute(end) - F.minute(start))
    ).cast("bigint")


def floor_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0).cast("bigint"))


# Bucket labels of document and contract expiry, in report order (fixed values).
EXPIRY_BUCKETS = ("expired", "0_30", "31_60", "61_90", "90_plus", "missing_date")


def expiry_bucket(expiry: Column | str, anchor: Column) -> Column:
    """Days from the anchor date to an expiry date, as a report bucket."""
    days = F.datediff(as_col(expiry), anchor)
    return (
        F.when(days.isNull(), "missing_date")
        .when(days < 0, "expired")
        .when(days <= 30, "0_30")
        .when(days <= 60, "31_60")
        .when(days <= 90, "61_90")
        .otherwise("90_plus")
    )


def overlaps(opened: Column | str, closed: Column | str, start: Column, end: Column) -> Column:
    """Opened by the end of the window and not closed before its start."""
    return (as_col(opened) <= end) & (as_col(closed).isNull() | (as_col(closed) >= start))


def any_text(columns: Iterable[Column | str], needle: str) -> Column:
    """Case-insensitive substring search over several columns."""
    return F.lower(F.concat_ws(" ", *[as_col(c).cast("string") for c in columns])).contains(needle.lower())
