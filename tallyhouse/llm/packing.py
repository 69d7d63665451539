"""Best-two-fit packing of token pieces into sequences.

Only lengths matter to a packing, and there are at most as many lengths as the
capacity, so the whole corpus is packed through its histogram: the driver holds
a count for each length, never a list of documents. ``plan`` fills a bin
greedily, then tries to replace its smallest piece by two unpacked pieces that
fit the expanded gap more tightly, and repeats the bin as often as the counts
allow. Spark numbers the pieces by length and looks up the place of each number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyhouse.llm.ordering import numbered
from tallyhouse.llm.tokens import encoder, texts_of
from tallyhouse.session import pin

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, vocab: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, end it with ``end_id`` and cut what is longer than ``capacity``.

    doc_id, piece (from 0), start, length, ids_crc32 and, if asked, ids as
    little-endian unsigned 32-bit numbers. A null text is an empty document of
    one token. Repeated rows are packed each; other columns are ignored.
    """
    import zlib

    shape = PIECES + ", ids binary" * with_ids
    names = [f.split()[0] for f in shape.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step = np.asarray([end_id], dtype="<u4").tobytes(), capacity * 4
        for batch in batches:
            found = {k: [] for k in names}
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(vocab).ids(texts_of(batch.column(1)))):
                ids += end
                for number, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for name, value in zip(names, row):
                        found[name].append(value)
                held += len(ids) * with_ids
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pydict(found, schema=_schema(with_ids))
                    found, held = {k: [] for k in names}, 0
            yield pa.RecordBatch.from_pydict(found, schema=_schema(with_ids))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, shape)


def _schema(with_ids: bool) -> pa.Schema:
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    return pa.schema(fields + [("ids", pa.binary())] * with_ids)


def _two(left: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths whose sum is largest, above ``least`` and at most ``room``."""
    lengths = np.arange(len(left))
    longest = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # the longest unpacked length up to each length
    first = lengths[1 : min(room, len(left))][left[1 : min(room, len(left))] > 0]
    if not len(first):
        return None
    rest = np.minimum(room - first, first)
    second = longest[rest]
    alone = (second == first) & (left[first] < 2)
    second = np.where(alone, longest[np.maximum(np.minimum(rest, first - 1), 0)], second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] > least else None


def plan(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many bins, [(length, times), ...]) that use up ``counts`` (by length, up to the capacity)."""
    left, capacity, out = counts.astype(np.int64).copy(), len(counts) - 1, []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return out
        longest = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
        used: dict[int, int] = {}
        gap, top = capacity, int(lengths[-1])
        while top:
            times = int(min(left[top], gap // top))
            used[top] = times
            gap -= times * top
            top = int(longest[min(gap, top - 1)])
        smallest = min(used)
        if gap and sum(used.values()) > 1:
            free = left.copy()
            for length, times in used.items():
                free[length] -= times
            if pair := _two(free, gap + smallest, smallest):
                used[smallest] -= 1
                for length in pair:
                    used[length] = used.get(length, 0) + 1
        used = {length: times for length, times in used.items() if times}
        bins = min(int(left[length]) // times for length, times in used.items())
        for length, times in used.items():
            left[length] -= bins * times
        out.append((bins, sorted(used.items(), reverse=True)))


def segments(patterns: list[tuple[int, list[tuple[int, int]]]], counts: np.ndarray) -> np.ndarray:
    """Where the pieces go, numbered from 0 by rising length.

    Columns: first number, pieces in a bin (times), first sequence, offset in
    the sequence, length. Piece ``k`` of a segment is in sequence
    ``first + k // times`` at ``offset + k % times * length``.
    """
    at = np.concatenate(([0], np.cumsum(counts)))  # first number of each length
    rows, sequence = [], 0
    for bins, used in patterns:
        offset = 0
        for length, times in used:
            rows.append((at[length], times, sequence, offset, length))
            at[length] += bins * times
            offset += times * length
        sequence += bins
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with a length of 1 to ``capacity``; other columns pass through.

    The driver receives one count for each length (at most ``capacity``). Rows
    need doc_id and piece only to be numbered in a stable order. Rows with a
    null length, or one outside the bounds, raise an error. An empty frame
    gives an empty one.
    """
    counted = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).where("length BETWEEN 1 AND %d" % capacity).collect()}
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counted.items():
        counts[length] = n
    places = segments(plan(counts), counts)
    ordered = numbered(found, [F.col("length"), F.col("doc_id"), F.col("piece")], index="_number")
    fields = [f for f in ordered.schema.fields if f.name != "_number"]
    schema = StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(batch.schema.get_field_index("_number")).to_numpy(zero_copy_only=False)
            length = batch.column(batch.schema.get_field_index("length")).fill_null(0).to_numpy(zero_copy_only=False)
            row = places[np.searchsorted(places[:, 0], number, side="right") - 1] if len(places) else np.zeros((len(number), 5))
            if (row[:, 4] != length).any():
                raise ValueError(f"lengths must be from 1 to {capacity}")
            k = number - row[:, 0]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            columns += [pa.array(row[:, 2] + k // row[:, 1]), pa.array(row[:, 3] + k % row[:, 1] * row[:, 4])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return ordered.mapInArrow(place, schema)


def pack_documents(documents: DataFrame, vocab: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of whole documents with their sequence_id and offset."""
    return pack(pin(pieces(documents, vocab, end_id, capacity, with_ids)), capacity)
