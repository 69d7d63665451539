"""Deterministic row numbers without a single-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import pin


def surrogate_id(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Number rows 1..n by ``order`` (ascending, NULLs last), as ``name``.

    Rows are range-partitioned on the order columns, then a hash of the whole
    row, so ties are broken the same way on every cluster, then a random salt
    that lets many equal rows spread over partitions. They are sorted inside
    each partition and stored, which fixes the partition of every row. The position in
    the partition plus the row count of the partitions before it is the number.
    Only one count per partition is gathered to compute the offsets.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    laid_out = (
        df.withColumn("_tie", F.xxhash64(*[F.col(c) for c in df.columns]))
        .withColumn("_salt", F.rand(17))
        .repartitionByRange(*keys, F.col("_tie"), F.col("_salt"))
        .sortWithinPartitions(*keys, F.col("_tie"), F.col("_salt"))
        .withColumn("_slot", F.monotonically_increasing_id())
        .drop("_salt", "_tie")
    )
    fixed = pin(laid_out)
    # The upper bits of the slot are the partition, the lower 33 the position in it.
    part = F.shiftright("_slot", 33)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .select((F.col("_offset") + position + 1).alias(name), *df.columns)
    )
