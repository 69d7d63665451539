"""Token counts from flat token files that have no index.

A flat file is ids one after another, each document ended by a separator id.
It is kept as blocks of a fixed number of ids that pay no heed to documents.
Every block is searched for separators by itself; a prefix scan over the
blocks' short summaries then joins documents that cross a border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.tokens import encoder, texts_of

#: Ids of a block.
BLOCK_IDS = 1 << 18
FLAT = "kind string, shard int, block long, ids binary, doc_ids array<long>"


def write_flat(documents: DataFrame, path: str, vocab: str, separator: int, block_ids: int = BLOCK_IDS) -> None:
    """Write ids as unsigned 16-bit numbers, one flat stream for each input split.

    ``kind=ids`` holds the blocks. ``kind=names`` lists the doc_ids in the
    order of the stream, so that counts can be given names; it says nothing
    about lengths. Null texts are empty documents. The name of a special id
    in a text is plain text; a separator inside a document is an error.
    """

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, end = TaskContext.get().partitionId(), np.asarray([separator], dtype="<u2")
        waiting, held, block, named = [], 0, 0, 0

        def row(kind: str, number: int, ids: bytes | None, names: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"kind": kind, "shard": shard, "block": number, "ids": ids, "doc_ids": names}], schema=FLAT_SCHEMA)

        for batch in batches:
            names = batch.column(0).to_pylist()
            if names:
                yield row("names", named, None, names)
                named += len(names)
            for raw in encoder(vocab, plain=True).ids(texts_of(batch.column(1))):
                ids = np.frombuffer(raw, dtype="<u4")
                if (ids == separator).any():
                    raise ValueError("a document holds the separator")
                if len(ids) and ids.max() > 0xFFFF:
                    raise ValueError("flat files hold ids up to 65535")
                waiting += [ids.astype("<u2"), end]
                held += len(ids) + 1
                if held >= block_ids:
                    stream = np.concatenate(waiting)
                    full = held - held % block_ids
                    for at in range(0, full, block_ids):
                        yield row("ids", block, stream[at : at + block_ids].tobytes(), None)
                        block += 1
                    waiting, held = [stream[full:]], held - full
        if held:
            yield row("ids", block, np.concatenate(waiting).tobytes(), None)

    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    documents.mapInArrow(flat, FLAT).write.partitionBy("kind").option("compression", "zstd").parquet(path)


FLAT_SCHEMA = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])


def flat_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FLAT).parquet(path).where("kind = 'ids'").select("shard", "block", "ids")


def flat_names(spark: SparkSession, path: str) -> DataFrame:
    """shard, ordinal and doc_id of every document of the stream."""
    names = spark.read.schema(FLAT).parquet(path).where("kind = 'names'").select("shard", "block", F.posexplode("doc_ids").alias("at", "doc_id"))
    return names.select("shard", (F.col("block") + F.col("at")).alias("ordinal"), "doc_id")


def named_counts(counted: DataFrame, names: DataFrame) -> DataFrame:
    """The counts with their doc_id; reading n_tokens fails if a shard has other documents than names."""
    found = counted.withColumn("_found", F.lit(True)).join(names.withColumn("_named", F.lit(True)), ["shard", "ordinal"], "full")
    both = F.col("_found").isNotNull() & F.col("_named").isNotNull()
    return found.withColumn("n_tokens", F.when(both, F.col("n_tokens")).otherwise(F.raise_error(F.lit("documents and names of a shard differ")).cast("long"))).drop("_found", "_named")


def count_tokens(blocks: DataFrame, separator: int, across_shards: bool = False) -> DataFrame:
    """One row for each document: shard, ordinal, start, n_tokens (without separator), ended.

    ``blocks`` has shard, block (its order in the shard) and ids (unsigned
    16-bit). Each shard is a stream of its own, or, with ``across_shards``, all
    shards are one stream in ascending order, and ``ordinal`` and ``start``
    count over the whole of it. Ids after the last separator are a document
    with ``ended`` false; a stream without ids gives no row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k: [] for k in ("n", "cuts")}
            for ids in batch.column(2):
                values = np.frombuffer(ids.as_py() or b"", dtype="<u2")
                found["n"].append(len(values))
                found["cuts"].append(np.flatnonzero(values == separator))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found["n"], pa.int64()), pa.array(found["cuts"], pa.list_(pa.int64()))],
                ["shard", "block", "n", "cuts"],
            )

    scanned = blocks.select(F.col("shard").cast("int").alias("shard"), F.col("block").cast("long").alias("block"), "ids").mapInArrow(scan, "shard int, block long, n long, cuts array<long>")
    last = F.element_at("cuts", -1) + 1
    inside = Window.partitionBy("shard").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = (
        scanned.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("ordinal", F.coalesce(F.sum(F.size("cuts")).over(before), F.lit(0)).cast("long"))
        .withColumn("end_of_last", F.when(F.size("cuts") > 0, F.col("start") + last))
        .withColumn("open_since", F.max("end_of_last").over(before))
    )
    whole = local.groupBy("shard").agg(F.sum("n").alias("shard_n"), F.sum(F.size("cuts")).alias("shard_cuts"), F.max("end_of_last").alias("shard_last"))
    if across_shards:  # one row a shard
        earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        base = whole.select("shard", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(b) for c, b in (("shard_n", "base_n"), ("shard_cuts", "base_cuts"))], "shard_n", "shard_last")
        base = base.withColumn("shard_open", F.max(F.col("base_n") + F.col("shard_last")).over(earlier))
    else:
        base = whole.select("shard", F.lit(0).alias("base_n"), F.lit(0).alias("base_cuts"), "shard_n", "shard_last", F.lit(0).alias("shard_open"))
    # Where each block's first document began: in this shard, or before it.
    placed = local.join(base, "shard").withColumn("open", F.coalesce(F.col("base_n") + F.col("open_since"), "shard_open", F.lit(0)))
    at = F.col("base_n") + F.col("start")
    edges = F.transform("cuts", lambda c, i: F.struct((F.col("base_cuts") + F.col("ordinal") + i).alias("ordinal"), F.when(i == 0, F.col("open")).otherwise(at + F.element_at("cuts", i) + 1).alias("start"), (at + c).alias("stop")))
    ended = placed.select("shard", F.explode(edges).alias("d")).select("shard", F.col("d.ordinal").cast("long").alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tail = base.join(whole.select("shard", "shard_cuts"), "shard")
    tail = tail.orderBy(F.desc("shard")).limit(1) if across_shards else tail  # only the end of the whole stream can stay open
    opened = F.coalesce(F.col("base_n") + F.col("shard_last"), "shard_open", F.lit(0))
    left = F.col("base_n") + F.col("shard_n") - opened
    rest = tail.select("shard", (F.col("base_cuts") + F.col("shard_cuts")).cast("long").alias("ordinal"), opened.cast("long").alias("start"), left.cast("long").alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return ended.unionByName(rest)
