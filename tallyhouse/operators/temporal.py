"""As-of counts, period comparison, calendars, clocks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import as_col, floor_zero, minute_boundaries, ratio


def as_of_count(df: DataFrame, key: str, start: str, end: str, dates: Sequence[date], name: str = "headcount") -> DataFrame:
    """Distinct keys that have started by each date and not ended by it.

    A sweep over the dates: each row becomes the range of date positions it is
    alive at, equal ranges of a key are one, and what an earlier range of the
    key covers is cut off. A range adds one where it begins and takes one away
    behind its end; the running sum of these is the count. No row is made for a
    key and date, and a key has no more ranges than there are pairs of dates,
    however many rows it has.
    """
    days = sorted(set(dates))
    if not days:
        return df.sparkSession.createDataFrame([], f"as_of_date date, {name} bigint")
    calendar = F.array(*[F.lit(d) for d in days])
    first = F.size(F.filter(calendar, lambda d: d < F.col(start)))
    last = F.when(F.col(end).isNull(), len(days)).otherwise(F.size(F.filter(calendar, lambda d: d < F.col(end)))) - 1
    ranges = df.where(F.col(key).isNotNull() & F.col(start).isNotNull()).select(F.col(key).alias("_key"), first.alias("_first"), last.alias("_last"))
    ranges = ranges.where("_first <= _last").distinct()
    before = Window.partitionBy("_key").orderBy("_first", "_last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = ranges.withColumn("_first", F.greatest("_first", F.coalesce(F.max("_last").over(before) + 1, F.lit(0)))).where("_first <= _last")
    steps = fresh.select(F.inline(F.array(F.struct(F.col("_first").alias("_at"), F.lit(1).alias("_step")), F.struct((F.col("_last") + 1).alias("_at"), F.lit(-1).alias("_step")))))
    steps = steps.groupBy("_at").agg(F.sum("_step").alias("_step"))  # at most one row per date
    spine = df.sparkSession.createDataFrame(list(enumerate(days)), "_at int, as_of_date date")
    running = F.sum(F.coalesce("_step", F.lit(0))).over(Window.orderBy("_at"))
    return spine.join(F.broadcast(steps), "_at", "left").select("as_of_date", running.alias(name))


def working_days(first: Column, last: Column, weekend: Sequence[str] = ()) -> Column:
    """Number of days of [first, last] that are no weekend days, by arithmetic on day numbers."""
    a, b = F.unix_date(first), F.unix_date(last)
    count = b - a + 1
    for day in weekend:
        shift = WEEKDAYS.index(day)  # day 0 of the numbering is a Thursday
        count = count - (F.floor((b - shift) / 7) - F.floor((a - 1 - shift) / 7))
    return F.when(a <= b, count).otherwise(0).cast("bigint")


WEEKDAYS = ("Thursday", "Friday", "Saturday", "Sunday", "Monday", "Tuesday", "Wednesday")


def change(current: Column, previous: Column) -> tuple[Column, Column]:
    """Amount and share of change against a base that may be missing or zero."""
    base = F.coalesce(previous, F.lit(0.0))
    return current - base, ratio(current - base, base)


def expand_days(df: DataFrame, first: Column, last: Column, name: str, weekend: Sequence[str] = ()) -> DataFrame:
    """One row per day of [first, last] for each input row, without weekend days.

    The days are generated from the row itself, which replaces a range join with a calendar.
    """
    days = df.where(first <= last).withColumn(name, F.explode(F.sequence(first, last)))
    if weekend:
        days = days.where(~F.date_format(name, "EEEE").isin(list(weekend)))
    return days


def late_minutes(scheduled: Column | str, actual: Column | str, grace: int) -> Column:
    """Minutes after the scheduled time beyond the grace period, never below zero."""
    return F.when(
        as_col(actual).isNotNull() & as_col(scheduled).isNotNull(),
        floor_zero(minute_boundaries(scheduled, actual) - F.lit(grace)),
    ).otherwise(F.lit(0).cast("bigint"))


def sla_status(opened: Column, closed: Column, due: Column, anchor: Column) -> Column:
    """Clock result of a case; open cases are judged at the anchor date."""
    return (
        F.when(opened.isNull() | due.isNull(), "Not Eligible")
        .when(F.coalesce(closed, anchor) > due, "Breached")
        .when(closed.isNotNull(), "Compliant")
        .otherwise("Pending")
    )


def aging_days(opened: Column, closed: Column, anchor: Column) -> Column:
    return F.datediff(F.coalesce(closed, anchor), opened).cast("bigint")


# Aging bands of open items with their inclusive upper limits (fixed values).
AGING_BANDS = ((3, "0_3_days"), (7, "4_7_days"), (14, "8_14_days"), (30, "15_30_days"))


def aging_band(days: Column) -> Column:
    """Band of an age in days; missing and negative ages fall into the last band."""
    chain = F.when(days.isNull() | (days < 0), "30_plus_days")
    for limit, label in AGING_BANDS:
        chain = chain.when(days <= limit, label)
    return chain.otherwise("30_plus_days")


def entity_months(df: DataFrame, key: str, start: Column, end: Column, first: date | None = None, last: date | None = None) -> DataFrame:
    """One row per entity and month in which it is alive; a caller may bound it by a report window.

    Without ``last`` an entity that has no end counts up to the current month.
    """
    until = F.lit(last) if last else F.current_date()
    from_month, to_month = F.trunc(start, "month"), F.trunc(F.coalesce(end, until), "month")
    from_month = F.greatest(from_month, F.trunc(F.lit(first), "month")) if first else from_month
    to_month = F.least(to_month, F.trunc(F.lit(last), "month")) if last else to_month
    return df.where(from_month <= to_month).withColumn(
        "month_start", F.explode(F.sequence(from_month, to_month, F.expr("interval 1 month")))
    )
