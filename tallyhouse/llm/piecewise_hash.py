"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes decides, by the text alone, where a
piece ends; each piece becomes one letter. An edit changes the letters around
it and leaves the others, so likeness is the edit distance of two letter rows.
The block size (bytes of a piece on average) is a power of two chosen by the
number of pieces, and a fingerprint holds the letters for it and its double,
so that texts of somewhat different length still have one block size in common.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import pin

#: Bytes that decide about an end, fewest pieces wanted, most letters of a row, letters that two rows must share in a run.
SPAN, LEAST, MOST, RUN = 7, 32, 64, 7
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTER = np.frombuffer(LETTERS.encode(), dtype=np.uint8)
_CODE = np.full(256, 64, dtype=np.uint8)
_CODE[_LETTER] = np.arange(64, dtype=np.uint8)
MULTIPLIER = 0x01000193
PART = 1 << 20


def end_levels(data: bytes) -> np.ndarray:
    """For each byte the number of low one-bits of the rolling hash that ends there: block size 2^k ends at levels from k on."""
    x = np.frombuffer(data, dtype=np.uint8)
    out = np.empty(len(x), dtype=np.uint8)
    for a in range(0, len(x), PART):
        own = x[max(0, a - SPAN + 1) : a + PART].astype(np.uint32)
        rolling, skip = own.copy(), min(a, SPAN - 1)
        for k in range(1, min(SPAN, len(own))):
            rolling[k:] += own[: len(own) - k] * np.uint32(pow(MULTIPLIER, k, 1 << 32))
        rolling = rolling[skip:]
        rolling ^= rolling >> np.uint32(15)
        rolling *= np.uint32(0x2C1B3C6D)
        rolling ^= rolling >> np.uint32(13)
        low = rolling & ~(rolling + np.uint32(1))  # the low ones
        out[a : a + PART] = np.bitwise_count(low)
    return out


def _letters(data: memoryview, ends: np.ndarray) -> str:
    """A letter for each piece; the last letter of a full row stands for all the rest."""
    cuts = [0, *ends[: MOST - 1].tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    # The checksum's bits are mixed, since a letter takes but six of them.
    return "".join(LETTERS[(zlib.crc32(data[a:b]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26] for a, b in zip(cuts, cuts[1:]))


def fingerprint(data: bytes) -> str:
    """``block size:letters:letters at twice that size``; the block is the largest with at least 32 ends, or one byte."""
    levels = end_levels(data)
    ends = np.bincount(levels, minlength=33)[::-1].cumsum()[::-1]  # ends at each level and above
    level = max(0, int(np.count_nonzero(ends >= LEAST)) - 1)
    view = memoryview(data)
    rows = [_letters(view, np.flatnonzero(levels >= k) + 1) for k in (level, level + 1)]
    return f"{1 << level}:{rows[0]}:{rows[1]}"


def _packed(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of many rows, 64 wide, and their lengths; 64 fills up."""
    codes = np.full((len(rows), MOST), 64, dtype=np.uint8)
    for i, row in enumerate(rows):
        codes[i, : len(row)] = _CODE[np.frombuffer(row.encode(), dtype=np.uint8)]
    return codes, np.array([len(r) for r in rows], dtype=np.int64)


def common_letters(a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each pair of rows, by bit vectors: one 64-bit word is one row of the table."""
    bits = np.uint64(1) << np.arange(MOST, dtype=np.uint64)
    row = np.full(len(a), ~np.uint64(0))
    for j in range(MOST):
        match = ((a == b[:, j, None]) & (a < 64)) @ bits
        match[j >= n_b] = 0
        both = row & match
        row = (row + both) | (row - both)
    return np.bitwise_count(~row).astype(np.int64)


def share_run(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether each pair of rows has a run of seven letters in common, or of all of the shorter one's if that has fewer."""
    run = np.zeros(len(a), dtype=bool)
    need = np.minimum(RUN, np.minimum(n_a, n_b))
    for shift in range(1 - MOST, MOST):
        x, y = a[:, max(0, -shift) : MOST - max(0, shift)], b[:, max(0, shift) : MOST - max(0, -shift)]
        same = np.pad((x == y) & (x < 64), ((0, 0), (1, 0)))
        sums = np.cumsum(same, axis=1, dtype=np.int16)
        for length in np.unique(need[~run]).tolist():
            if 0 < length < sums.shape[1]:
                hit = (sums[:, length:] - sums[:, :-length] == length).any(axis=1)
                run |= hit & (need == length)
    return run


def row_likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """One less the share of letters that must go or come to turn one row into the other; 0 without a common run."""
    a, n_a = _packed([p[0] for p in pairs])
    b, n_b = _packed([p[1] for p in pairs])
    total = n_a + n_b
    value = 2 * common_letters(a, b, n_b) / np.maximum(total, 1)
    value[~share_run(a, n_a, b, n_b)] = 0
    return value


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints: 1 if equal, 0 without a block size in common, else the best of the rows of one block size."""
    out = [float(a == b) for a, b in pairs]
    rows, owner = [], []
    for i, (a, b) in enumerate(pairs):
        if a != b:
            (k, *left), (m, *right) = a.split(":"), b.split(":")
            for x, own in zip((int(k), 2 * int(k)), left):
                for y, other in zip((int(m), 2 * int(m)), right):
                    if x == y and own and other:
                        rows.append((own, other))
                        owner.append(i)
    for at in range(0, len(rows), 1000):
        for i, value in zip(owner[at : at + 1000], row_likeness(rows[at : at + 1000]).tolist()):
            out[i] = max(out[i], value)
    return out


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as many code points from the start of the following text, or by all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGES = f"{RESULT}, task int, head string, tail string"


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _results(rows: list[tuple[int | None, str, str, str, str]]) -> list[dict]:
    """From doc_id, text, fingerprint, the next document's start and its fingerprint."""
    out = []
    for doc_id, text, own, following, _ in rows:
        data = _utf8(edited(text, following))
        out.append({"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(data).hexdigest(), "fingerprint": own, "edited_fingerprint": fingerprint(data)})
    near = likeness([(r["fingerprint"], r["edited_fingerprint"]) for r in out])
    nearest = likeness([(r[2], r[4]) for r in rows])
    return [r | {"near_edited": a, "near_next": b} for r, a, b in zip(out, near, nearest)]


def _arrow(schema: str) -> Callable[[list[dict]], pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return lambda rows: pa.RecordBatch.from_pylist(rows, schema=fields)


def fingerprints(documents: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and the likeness to that and to the next document.

    The next document has the next smaller doc_id; equal doc_ids are ordered by
    a hash of the text, null ones come last, and after the last comes the first.
    A single document is next to itself. A null text is empty; two empty texts
    are alike, an empty and another one are not. Texts are read whole. An empty
    table gives no rows; extra columns are left out.

    Rows are sorted by range, so that next documents are in one task but for
    each task's last, which is told the first document of the task after it.
    """
    batch_of = _arrow(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            ready = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                own = fingerprint(_utf8(text))
                if waiting:
                    ready.append((*waiting, text[: len(waiting[1]) // 3], own))
                elif first:
                    yield batch_of([{"fingerprint": own, "task": task, "head": text}])
                waiting, first = (doc_id, text, own), False
            if ready:
                yield batch_of(_results(ready))
        if waiting:
            yield batch_of([{"doc_id": waiting[0], "fingerprint": waiting[2], "task": task, "tail": waiting[1]}])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("salt"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text"), F.col("salt")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = pin(dealt.mapInArrow(run, EDGES))
    heads = found.where("head IS NOT NULL").select("task", "head", F.col("fingerprint").alias("next_fingerprint"))
    tails = found.where("tail IS NOT NULL").select("doc_id", "tail", "fingerprint", "task")
    turn = Window.orderBy("task")  # one number for each task of the sort
    after = heads.select("task").select(F.coalesce(F.lead("task").over(turn), F.min("task").over(Window.partitionBy())).alias("next"), "task")
    edges = tails.join(after, "task").join(heads.withColumnRenamed("task", "next"), "next").select("doc_id", "tail", "fingerprint", "head", "next_fingerprint")
    result_of = _arrow(RESULT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield result_of(_results(list(rows)))

    names = [x.split()[0] for x in RESULT.split(", ")]
    return found.where("task IS NULL").select(names).unionByName(edges.mapInArrow(finish, RESULT))
