"""Positions in a global order, found without gathering rows in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyhouse.session import pin


def numbered(df: DataFrame, order: list[Column], index: str = "row_index", running: str | None = None, total: str | None = None) -> DataFrame:
    """Add the position of each row in ``order`` and, if asked, the sum of ``running`` over the rows before it.

    Rows are dealt by range and sorted inside each task, so a heavy key spreads
    over tasks as long as ``order`` ends in columns that tell its rows apart.
    Each task numbers its own rows; one count per task is then summed up.
    The numbered rows are stored once, so numbers do not change when a task is
    repeated. Rows equal in all of ``order`` get neighbouring numbers in any order.
    """
    fields = [*df.schema.fields, StructField("_task", IntegerType()), StructField(index, LongType())]
    fields += [StructField(total, LongType())] if running else []

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, amount = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, task, dtype=np.int32)), pa.array(np.arange(rows, rows + n))]
            names = [*batch.schema.names, "_task", index]
            if running:
                values = batch.column(batch.schema.get_field_index(running)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(values) + amount
                columns.append(pa.array(ends - values))
                names.append(total)
                amount = int(ends[-1]) if n else amount
            rows += n
            yield pa.RecordBatch.from_arrays(columns, names)

    stored = pin(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, StructType(fields)))
    ends = [F.max(F.col(index) + 1).alias("_rows")]
    ends += [F.max(F.col(total) + F.coalesce(running, F.lit(0))).alias("_amount")] if running else []
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = stored.groupBy("_task").agg(*ends)  # one row for each task of the sort
    base = tasks.select("_task", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in tasks.columns[1:]])
    base = F.broadcast(base)  # one row for each task of the sort
    out = stored.join(base, "_task").withColumn(index, F.col(index) + F.col("_rows"))
    if running:
        out = out.withColumn(total, F.col(total) + F.col("_amount"))
    return out.drop("_task", "_rows", "_amount")
