"""Keyed tables: inserts and updates as frames and as writes that touch only some files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import pin


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """Equal keys, where NULL equals NULL; the right side's keys carry a prefix."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The existing rows plus one row for each incoming key that is not there yet; a NULL key is a key like any other."""
    held = existing.select(*[F.col(k).alias(f"_held_{k}") for k in keys])
    fresh = incoming.dropDuplicates(list(keys))
    return existing.unionByName(fresh.join(held, _same(fresh, held, keys, "_held_"), "left_anti"))


def update_by_key(existing: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows with the non-NULL values of matching update rows; no row is added."""
    changed = [c for c in updates.columns if c not in keys]
    renamed = updates.select(*[F.col(c).alias(f"_new_{c}") for c in updates.columns])
    joined = existing.join(renamed, _same(existing, renamed, keys, "_new_"), "left")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in existing.columns]
    )


BUCKET = "_bucket"


class KeyedTable:
    """A stored table whose rows lie in buckets by a hash of their key, so that a change rewrites only the buckets it meets.

    Changes are prepared from the buckets with touched keys, stored, and then
    put in place of those buckets; the files of all others stay as they are. The
    number of buckets is part of the layout and must be the same at every use.
    A heavy bucket is written by many tasks. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def _put(self, df: DataFrame) -> None:
        dealt = self._dealt(df)
        spread = dealt.repartition(BUCKET, F.xxhash64(*dealt.columns) % 8)
        spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, df: DataFrame) -> None:
        self._put(df)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def _touched(self, changes: DataFrame) -> list[int]:
        """The buckets of the changed keys: a number each, no more than there are buckets."""
        return sorted(r[0] for r in self._dealt(changes).select(BUCKET).distinct().collect())

    def insert(self, incoming: DataFrame) -> list[int]:
        """Add one row for each key that is not there yet; the buckets rewritten are returned."""
        held = self._stored()
        keys = self._dealt(held.select(*self.keys).distinct()).withColumnsRenamed({k: f"_held_{k}" for k in self.keys}).drop(BUCKET)
        fresh = incoming.dropDuplicates(self.keys)
        fresh = pin(fresh.join(keys, _same(fresh, keys, self.keys, "_held_"), "left_anti"))
        return self._replace(fresh, lambda old: old.unionByName(fresh.select(old.columns)))

    def update(self, updates: DataFrame) -> list[int]:
        """Set the non-NULL values of the updates where their key is held. An update's key must be unique."""
        updates = pin(updates)
        return self._replace(updates, lambda old: update_by_key(old, updates, self.keys))

    def _replace(self, changes: DataFrame, made) -> list[int]:
        touched = self._touched(changes)
        if touched:
            old = self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET)
            self._put(pin(made(old)))
        return touched


class MonthTable:
    """A history partitioned by month, of which a late change rewrites only its own months.

    History keeps what was true in each month; only a change that is dated back
    alters it, from the month it holds from. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, month: str, key: str):
        self.spark, self.path, self.month, self.key = spark, path, month, key

    def write(self, rows: DataFrame) -> None:
        """Put the months that occur in ``rows`` in place of the stored ones; a heavy month is cut by key."""
        ordered = rows.repartitionByRange(self.month, self.key).sortWithinPartitions(self.month, self.key)
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.month).parquet(self.path)

    def read(self) -> DataFrame:
        """The table; months are text, also where they look like numbers."""
        stored = self.spark.read.parquet(self.path)
        return stored.withColumn(self.month, F.col(self.month).cast("string"))

    def correct(self, changes: DataFrame, since: str = "from_month") -> list[str]:
        """Set the non-NULL values of ``changes`` for their key in every stored month from ``since`` on; the rewritten months are returned.

        Of several changes of a key for a month the one with the latest ``since``
        holds for each value.
        """
        changed = [c for c in changes.columns if c not in (self.key, since)]
        changes = pin(changes.where(F.col(self.key).isNotNull()))
        table = self.read()
        joined = table.join(changes.select(self.key, since), self.key).where(F.col(self.month) >= F.col(since))
        months = sorted(r[0] for r in joined.select(self.month).distinct().collect())  # a value a month
        if not months:
            return []
        rows = table.where(F.col(self.month).isin(months))
        latest = [F.max_by(F.col(f"_new_{c}"), F.when(F.col(f"_new_{c}").isNotNull(), F.col(since))).alias(f"_new_{c}") for c in changed]
        named = changes.select(self.key, since, *[F.col(c).alias(f"_new_{c}") for c in changed])
        # A change is copied to the months it reaches, of which there are few.
        reached = F.filter(F.array(*[F.lit(m) for m in months]), lambda m: m >= F.col(since))
        reach = named.withColumn(self.month, F.explode(reached)).groupBy(self.key, self.month).agg(*latest)
        fresh = rows.join(reach, [self.key, self.month], "left")
        self.write(pin(fresh.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in table.columns])))
        return months


def write_snapshot(row: DataFrame, path: str) -> None:
    """Replace a one-row snapshot table."""
    row.coalesce(1).write.mode("overwrite").parquet(path)
