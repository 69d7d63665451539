"""Token-id files: one zstandard frame per document, all with one shared dictionary.

Layout of a folder written by ``write_token_files``:

``dictionary/``  one row: ``dict_hash`` and the dictionary's bytes
``blocks/``      rows of neighbouring documents in ascending order: their ids,
                 token counts, the byte offsets of their frames, the hash of the
                 dictionary, and the frames one after another

A short document is read by its block's offset index: the block is found by the
column statistics of ``first_doc_id`` and ``last_doc_id``, and one frame is
decompressed. Both tables are written by Spark's committer, so a lost executor
leaves no half-written file behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.tokens import encoder, texts_of

#: A block ends at so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: The dictionary is trained on at most so many documents of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 20_000, 64 << 10

BLOCKS = (
    "shard int, block int, token_start long, n_tokens_block long, first_doc_id long, last_doc_id long, "
    "doc_ids array<long>, n_tokens array<int>, offsets array<long>, dict_hash string, payload binary"
)


def dictionary_hash(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(documents: DataFrame, vocab: str, end_id: int) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of documents.

    The sample is ``SAMPLE_DOCS`` documents with the smallest hashes of their
    ids among those of at most ``SAMPLE_CHARS`` characters. Too few documents
    to train on give an empty dictionary; frames then use none.
    """
    import zstandard

    short = documents.where(F.length("text") <= SAMPLE_CHARS)
    ids = [r[0] for r in short.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()]
    texts = [r[0] for r in short.where(F.col("doc_id").isin(ids)).select("text").limit(SAMPLE_DOCS).collect()]
    end = np.asarray([end_id], dtype="<u4").tobytes()
    samples = [ids + end for ids in encoder(vocab).ids(sorted(texts))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_token_files(documents: DataFrame, path: str, vocab: str, end_id: int = 0) -> None:
    """Encode every whole text, end it with ``end_id`` and write the files in ascending doc_id order.

    A null text counts as empty; a null doc_id sorts first; repeated doc_ids
    are kept as separate documents, ordered by text. Other columns are ignored.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = train_dictionary(documents, vocab, end_id)
    name = dictionary_hash(raw)
    spark.createDataFrame([(name, bytearray(raw))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw))
        shard, end = TaskContext.get().partitionId(), np.asarray([end_id], dtype="<u4").tobytes()
        ids, counts, frames, size, block, before = [], [], [], 0, 0, 0

        def full() -> pa.RecordBatch:
            nonlocal ids, counts, frames, size, block, before
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames], dtype=np.int64)))
            known = [i for i in ids if i is not None]
            row = {
                "shard": shard, "block": block, "token_start": before, "n_tokens_block": sum(counts),
                "first_doc_id": min(known, default=None), "last_doc_id": max(known, default=None),
                "doc_ids": ids, "n_tokens": counts, "offsets": offsets.tolist(), "dict_hash": name, "payload": b"".join(frames),
            }
            before, block = before + row["n_tokens_block"], block + 1
            ids, counts, frames, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for doc_id, tokens in zip(doc_ids, encoder(vocab).ids(texts_of(batch.column(1)))):
                frame = shrink.compress(tokens + end)
                ids.append(doc_id)
                counts.append(len(tokens) // 4 + 1)
                frames.append(frame)
                size += len(frame)
                if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield full()
        if ids:
            yield full()

    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ordered = documents.repartitionByRange(order[0]).sortWithinPartitions(*order)
    ordered.mapInArrow(to_blocks, BLOCKS).write.parquet(f"{path}/blocks")


BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("token_start", pa.int64()), ("n_tokens_block", pa.int64()),
    ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
    ("offsets", pa.list_(pa.int64())), ("dict_hash", pa.string()), ("payload", pa.binary()),
])


def stored_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    name, raw = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(raw)
    if dictionary_hash(raw) != name:
        raise ValueError(f"the dictionary in {path} does not have the hash {name}")
    return name, raw


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked, ids."""
    import zlib

    name, raw = stored_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens_block").alias("n"))  # one row for each file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                if row["dict_hash"].as_py() != name:
                    raise ValueError(f"a block was written with another dictionary: {row['dict_hash']}")
                counts, payload, offsets = np.asarray(row["n_tokens"].as_py(), dtype=np.int64), row["payload"].as_py(), row["offsets"].as_py()
                ids = [expand.decompress(payload[a:b]) for a, b in zip(offsets, offsets[1:])]
                if [len(x) for x in ids] != (counts * 4).tolist():
                    raise ValueError("a frame does not hold the tokens its index promises")
                start = row["base"].as_py() + row["token_start"].as_py() + np.cumsum(counts) - counts
                columns = [pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(start), pa.array(counts), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                columns += [pa.array(ids, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in shape.split(", ")])

    return blocks.join(base, "shard").select("token_start", "base", "doc_ids", "n_tokens", "offsets", "dict_hash", "payload").mapInArrow(decode, shape)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document by the offset index (a list per row of that doc_id): only its frames are decompressed."""
    import zstandard

    name, raw = stored_dictionary(spark, path)
    expand = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id))
    frames = (
        blocks.select("shard", "block", "payload", F.posexplode(F.arrays_zip("doc_ids", "offsets", F.slice("offsets", 2, F.size("doc_ids")).alias("ends"))))
        .where(F.col("col.doc_ids") == doc_id)
        .orderBy("shard", "block", "pos")
        .select(F.expr("substring(payload, cast(col.offsets + 1 AS int), cast(col.ends - col.offsets AS int))").alias("frame"))
    )
    return [np.frombuffer(expand.decompress(bytes(r.frame)), dtype="<u4").tolist() for r in frames.collect()]
