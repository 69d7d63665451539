"""Two-source reconciliation and build-failing assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import as_col

CHECK_COLUMNS = ("check_name", "expected", "actual", "difference", "tolerance", "passed")


class ReconciliationError(ValueError):
    """Raised when a check of a finished build does not hold."""


def presence_status(left: Column, right: Column, both: str, left_only: str, right_only: str, neither: str) -> Column:
    """Which of two sources carries a positive amount."""
    return (
        F.when((left > 0) & (right > 0), both)
        .when((left > 0) & (right == 0), left_only)
        .when((left == 0) & (right > 0), right_only)
        .otherwise(neither)
    )


def checks_of(row: DataFrame, specs: list[tuple[str, Column | str, Column | str, float]]) -> DataFrame:
    """Several checks over the same one-row frame in one pass."""
    entries = []
    for name, expected, actual, tolerance in specs:
        want, got = as_col(expected).cast("double"), as_col(actual).cast("double")
        gap = F.abs(want - got)
        entries.append(
            F.struct(
                F.lit(name).alias("check_name"),
                want.alias("expected"),
                got.alias("actual"),
                F.round(gap, 6).alias("difference"),
                F.lit(float(tolerance)).alias("tolerance"),
                F.coalesce(gap <= tolerance + 1e-9, want.isNull() & got.isNull()).alias("passed"),
            )
        )
    return row.select(F.inline(F.array(*entries)))


def all_checks(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def require(results: DataFrame) -> None:
    """Fail the build if any check failed, naming every failed one (a row for each check, not for each record)."""
    failed = results.where(~F.coalesce("passed", F.lit(False))).collect()
    if failed:
        lines = "; ".join(f"{r.check_name}: expected {r.expected}, got {r.actual}" for r in failed)
        raise ReconciliationError(f"{len(failed)} checks failed: {lines}")
