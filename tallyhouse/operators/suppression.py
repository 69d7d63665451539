"""Two-way tables with totals in which hidden cells cannot be worked out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.privacy import MIN_GROUP
from tallyhouse.session import pin


def protected_table(df: DataFrame, rows: str, columns: str, measure: Column, name: str, minimum: int = MIN_GROUP) -> DataFrame:
    """A measure per group of two keys with all totals; small groups are hidden, and others with them.

    Every line of the table adds up to its total, so a single hidden cell of a
    line follows from the others. For each small cell the three other corners of
    a rectangle are hidden as well, those with the fewest rows, and totals only
    where nothing else is left. A cell that is a corner of a hidden rectangle can
    be raised and lowered with its neighbours without changing any line, so no
    sum of shown cells gives it away. Totals of small groups count as small cells.

    ``state`` is shown, small or protecting; a hidden cell has no value. NULL is
    a key of its own. A small cell without any rectangle, in a table of one cell,
    is hidden alone, as its total is then the same small group. The work grows
    with the cells of the table, not with the rows.
    """
    total_of = lambda key: F.grouping(key) == 1
    mark = lambda key: F.when(F.col(f"_{key}_all"), "all").otherwise(F.concat(F.lit("="), F.coalesce(F.col(key).cast("string"), F.lit("\\0"))))
    cells = df.cube(rows, columns).agg(
        total_of(rows).alias(f"_{rows}_all"), total_of(columns).alias(f"_{columns}_all"), F.count(F.lit(1)).alias("group_size"), measure.alias("_value")
    )
    cells = pin(cells.select(rows, columns, mark(rows).alias("_r"), mark(columns).alias("_c"), "group_size", "_value"))
    small = F.col("group_size") < minimum
    place = cells.select("_r", "_c", F.col("group_size").alias("_n"))
    besides = place.select("_r", F.col("_c").alias("_c2"), F.col("_n").alias("_n1"))
    below = place.select(F.col("_r").alias("_r2"), "_c", F.col("_n").alias("_n2"))
    corner = place.select(F.col("_r").alias("_r2"), F.col("_c").alias("_c2"), F.col("_n").alias("_n3"))
    found = cells.where(small).select("_r", "_c").join(besides, "_r").where("_c2 <> _c").join(below, "_c").where("_r2 <> _r").join(corner, ["_r2", "_c2"])
    totals = (F.col("_c2") == "all").cast("int") + (F.col("_r2") == "all").cast("int")
    best = found.groupBy("_r", "_c").agg(F.min(F.struct(totals.alias("t"), (F.col("_n1") + F.col("_n2") + F.col("_n3")).alias("n"), "_c2", "_r2")).alias("b"))
    corners = F.array(*[F.struct(a.alias("_r"), b.alias("_c")) for a, b in ((F.col("_r"), F.col("b._c2")), (F.col("b._r2"), F.col("_c")), (F.col("b._r2"), F.col("b._c2")))])
    hidden = best.select(F.inline(corners)).distinct().withColumn("_hidden", F.lit(True))
    state = F.when(small, "small").when(F.col("_hidden"), "protecting").otherwise("shown")
    return cells.join(hidden, ["_r", "_c"], "left").select(
        rows,
        columns,
        (F.col("_r") == "all").alias(f"{rows}_total"),
        (F.col("_c") == "all").alias(f"{columns}_total"),
        "group_size",
        F.when(state == "shown", F.col("_value")).alias(name),
        state.alias("state"),
    )
