"""Reusable relational shapes built from DataFrame operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import as_col


def latest_record(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order``.

    The rank filter becomes a group limit before the exchange, so a task sends
    at most one row of a key and a hot key does not travel whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def repeated_keys(df: DataFrame, keys: Sequence[str], more_than: int = 1) -> DataFrame:
    """Keys that occur more than ``more_than`` times; counted with map-side partials."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > more_than).drop("_n")


def with_repeat_flag(df: DataFrame, keys: Sequence[str], flag: str, weight: str | None = None) -> DataFrame:
    """Mark rows whose key is repeated, without gathering a key's rows in one window.

    If ``weight`` is named, ``df`` has one row for each key, which stands for that many.
    """
    if weight:
        return df.withColumn(flag, reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & (F.col(weight) > 1))
    repeated = repeated_keys(df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])), keys)
    marked = repeated.withColumn(flag, F.lit(True))
    return df.join(marked, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def with_member_flag(df: DataFrame, column: str, keys: DataFrame, flag: str) -> DataFrame:
    """Mark rows whose ``column`` is among the single-column ``keys``; NULL is no member.

    The keys are made distinct first, so the join keeps every row exactly once.
    """
    name = keys.columns[0]
    distinct = keys.where(F.col(name).isNotNull()).select(F.col(name).alias("_key")).distinct()
    return (
        df.join(distinct, F.col(column) == F.col("_key"), "left")
        .withColumn(flag, F.col("_key").isNotNull())
        .drop("_key")
    )


def keep_members(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``column IN (keys)``; the keys are made distinct first, so a key repeated many times is sent once per task."""
    known = keys.select(F.col(keys.columns[0]).alias("_key")).distinct()
    return df.join(known, F.col(column) == F.col("_key"), "left_semi")


def drop_members(df: DataFrame, column: str, keys: DataFrame, null_passes: bool = False) -> DataFrame:
    """``column NOT IN (keys)`` over the non-NULL keys, with an explicit rule for a NULL column."""
    known = keys.select(F.col(keys.columns[0]).alias("_key")).where("_key is not null").distinct()
    left = df if null_passes else df.where(F.col(column).isNotNull())
    return left.join(known, F.col(column) == F.col("_key"), "left_anti")


def full_join_unique(unique: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Full outer join of a frame with one row per key and a frame with any number.

    A skewed full outer join cannot be split, so it is put together from a left
    join, which can, and the keys only the unique side has.
    """
    matched = rows.join(unique, key, "left")
    alone = unique.where(F.col(key).isNotNull()).join(rows.select(key).distinct(), key, "left_anti")
    no_key = unique.where(F.col(key).isNull())
    return matched.unionByName(alone.unionByName(no_key), allowMissingColumns=True)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Put one-row frames next to each other as one row.

    The frames are stacked with NULL in foreign columns and folded by ``max``:
    no nested-loop join, and an empty frame gives NULL instead of losing the row.
    Frames may not share a column name, and none may have more than one row.
    """
    names = [c for f in frames for c in f.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns occur in several frames: {sorted({c for c in names if names.count(c) > 1})}")
    frames = [f.withColumn(f"_rows{i}", F.lit(1)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    single = F.greatest(*[F.coalesce(F.sum(f"_rows{i}"), F.lit(0)) for i in range(len(frames))], F.lit(0)) <= 1
    folded = [F.when(single, F.max(c)).otherwise(F.raise_error(F.lit("a frame has more than one row"))).alias(c) for c in names]
    return stacked.agg(*folded)


def stacked_counts(df: DataFrame, dimensions: dict[str, Column], measure: Column, name: str) -> DataFrame:
    """Counts of several single dimensions stacked as (category, metric_value, count).

    Each row is turned into one small row per dimension and aggregated once;
    partial aggregation shrinks the expansion before the exchange.
    """
    entries = [
        F.struct(F.lit(label).alias("category"), value.cast("string").alias("metric_value"))
        for label, value in dimensions.items()
    ]
    long = df.select(F.explode(F.array(*entries)).alias("_e"), *sorted({c for c in df.columns}))
    return long.groupBy("_e.category", "_e.metric_value").agg(measure.alias(name)).select("category", "metric_value", name)


def measures_to_rows(row: DataFrame, labels: dict[str, str], name: str, value: str) -> DataFrame:
    """Turn the measures of a one-row frame into labelled rows (one scan, not one per measure)."""
    entries = [F.struct(F.lit(label).alias(name), F.col(c).cast("double").alias(value)) for c, label in labels.items()]
    return row.select(F.inline(F.array(*entries)))


def add_group_total(groups: DataFrame, keys: Sequence[str], facts: DataFrame, measure: Column, name: str) -> DataFrame:
    """A correlated sum per group as a pre-aggregate and a left join; NULL keys get zero."""
    sums = facts.groupBy(*keys).agg(measure.alias(name))
    return groups.join(sums, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def browse(df: DataFrame, columns: Sequence[str], needle: str, order: Sequence[Column], page: int, size: int = 5) -> DataFrame:
    """Search over columns, sort, and return one page."""
    from tallyhouse.functions import any_text

    return df.where(any_text(columns, needle)).orderBy(*order).offset(page * size).limit(size)


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The distinct non-NULL values of each column as rows of ``field`` and ``value``.

    One pass over the table, one row for each value; nothing is gathered in one place.
    """
    entries = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*entries))).where("value IS NOT NULL").distinct()


def count_entities(df: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Distinct keys per condition: flags are folded per key, then summed.

    Several distinct counts over one key would multiply the rows; folding keeps one row per key.
    """
    folded = df.where(as_col(key).isNotNull()).groupBy(key).agg(
        *[F.max(F.coalesce(cond, F.lit(False))).alias(name) for name, cond in conditions.items()]
    )
    return folded.agg(*[F.count(F.when(F.col(name), 1)).alias(name) for name in conditions])
