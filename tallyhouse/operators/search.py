"""Substring search in stored rows by a trigram index, page by page."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM = 3


def searched_text(columns: Sequence[str]) -> Column:
    """What a search looks at: the columns in lower case, one space between them; NULL ones are left out."""
    return F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters."""
    count = F.char_length(text) - GRAM + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


class SearchIndex:
    """Rows sorted by their key, and for each trigram the blocks of rows that hold it.

    ``rows`` is stored in blocks of neighbouring keys. ``grams`` has one row for
    each trigram and block, not for each trigram and row, and is partitioned by
    a hash of the trigram; a search reads the partitions of its own trigrams,
    keeps the blocks that have them all, and looks at the rows of these blocks
    alone. The key is unique and has no NULL.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], columns: Sequence[str], block_rows: int = 256, parts: int = 64):
        self.spark, self.path, self.key, self.columns, self.block_rows, self.parts = spark, path, list(key), list(columns), block_rows, parts

    def build(self, df: DataFrame) -> None:
        # A block is cut inside one task of the sort: partition and position there give its number.
        laid = df.repartitionByRange(*self.key).sortWithinPartitions(*self.key).withColumn("_slot", F.monotonically_increasing_id())
        laid = laid.withColumn("_block", F.shiftright("_slot", 33) * F.lit(1 << 33) + F.floor(F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1)) / self.block_rows)).drop("_slot")
        laid.write.parquet(f"{self.path}/rows")
        grams = self._rows().select("_block", F.explode(trigrams(searched_text(self.columns))).alias("gram")).distinct()
        part = self._part(F.col("gram")).alias("part")
        grams = grams.select("*", part).repartition("part", F.xxhash64("gram") % 8).sortWithinPartitions("part", "gram")
        grams.write.partitionBy("part").parquet(f"{self.path}/grams")

    def _part(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.parts)).cast("int")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _blocks(self, grams: list[str]) -> DataFrame:
        """The blocks in which every trigram is found somewhere."""
        parts = sorted({r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(self._part(F.col("gram"))).collect()})
        held = self.spark.read.parquet(f"{self.path}/grams").where(F.col("part").isin(parts) & F.col("gram").isin(grams))
        return held.groupBy("_block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select("_block")

    def found(self, needle: str, after: tuple | None = None) -> DataFrame:
        """All rows that hold the needle, whatever its case, with a key behind ``after``."""
        wanted = needle.lower()
        grams = sorted({wanted[i : i + GRAM] for i in range(len(wanted) - GRAM + 1)})
        rows = self._rows()
        if after is not None:
            rows = rows.where(self._behind(after))
        if grams:  # shorter needles are looked for in all rows
            rows = rows.join(self._blocks(grams), "_block", "left_semi")
        return rows.where(F.contains(searched_text(self.columns), F.lit(wanted))).drop("_block")

    def _behind(self, after: tuple) -> Column:
        """Key > after, column by column, so that the scan can use the first one."""
        steps = []
        for i, (name, value) in enumerate(zip(self.key, after, strict=True)):
            equal = [F.col(k) == F.lit(v) for k, v in zip(self.key[:i], after[:i])]
            steps.append(reduce(lambda a, b: a & b, [*equal, F.col(name) > F.lit(value)]))
        return (F.col(self.key[0]) >= F.lit(after[0])) & reduce(lambda a, b: a | b, steps)

    def page(self, needle: str, after: tuple | None = None, size: int = 50) -> DataFrame:
        """The next ``size`` hits behind the last key of the page before."""
        return self.found(needle, after).orderBy(*self.key).limit(size)
