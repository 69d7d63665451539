"""Repeated passages: bytes covered by a string of ``LENGTH`` bytes that also starts earlier.

Each window of ``LENGTH`` bytes is given an anchor, the smallest of its hashes
of ``GRAM`` bytes, which equal windows have in common. Neighbouring windows
with one anchor make a span. Spans are dealt by range of anchor, content,
document and start and sorted, so a passage in very many documents spreads
over many tasks; a streaming pass drops anchors that occur once and tells

* spans whose very content was met before: they repeat as a whole;
* first spans of an anchor that has other content too: there the repeated
  windows have to be found.

The bytes of the latter are gathered in blocks. A block's suffix array, made
by two-stage sorting, puts equal windows next to each other, and the common
prefixes of neighbours show them. The spans of an anchor that has more of them
than a block holds are cut into pieces of few windows, which are told apart by
all the bytes those windows share, and go through the same steps. A piece that
still has too many contents is dealt to several blocks, and the windows that
are first in their block are compared among blocks by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.expressions import text_key
from tallyhouse.llm.ordering import numbered
from tallyhouse.llm.suffix_array import common_prefix_reaches, suffix_array, words_at
from tallyhouse.llm.textwords import lots, mixed, powers, utf8
from tallyhouse.session import pin

LENGTH, GRAM = 100, 32
#: Windows of a longer text are handled in segments of so many.
SEGMENT = 1 << 20
#: Spans of one anchor in a chunk; spans of anchors that share a block.
CHUNK, TOGETHER = 16384, 4096
#: Windows of a piece of a span whose anchor has more spans than a chunk.
PIECE = 10
#: A null doc_id comes before all others.
NO_ID = -(1 << 63)


def _anchors(text: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Spans of equal anchor: text number, start, anchor << 7 | windows, hash of content."""
    n, span = len(text), length - gram + 1
    windows = n - length + 1
    if windows < 1:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    down = powers("down", n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers("up", n), out=sums[1:])
    low = np.uint64(127)
    least = mixed((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1]) & ~low
    anchor = np.arange(len(least), dtype=np.int32)

    def smaller(left: slice, right: slice) -> None:
        """The smaller of two neighbouring stretches; of equal hashes the last one, so equal windows agree."""
        nonlocal least, anchor
        later = least[right] <= least[left]
        least, anchor = np.where(later, least[right], least[left]), np.where(later, anchor[right], anchor[left])

    reach = 1
    while reach * 2 <= span:
        smaller(slice(None, -reach), slice(reach, None))
        reach *= 2
    smaller(slice(0, windows), slice(span - reach, span - reach + windows))
    inside = np.zeros(windows + 1, dtype=np.int32)
    long = offsets[1:] - offsets[:-1] >= length
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - length + 1] -= 1
    inside = np.cumsum(inside)[:windows] > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1])
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    count = (last - first).astype(np.uint64)
    content = mixed((sums[last + length - 1] - sums[first]) * down[first] + count)
    owner = np.searchsorted(offsets, first, side="right") - 1
    key = least[first] | count
    return owner, first - offsets[owner], key.view(np.int64), content.view(np.int64)


SPANS = "anchor long, content long, doc long, start int"


def _spans(documents: DataFrame, length: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            text, offsets = utf8(batch.column(1))
            for a, b in lots(offsets):
                own, ends = text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                # A single long text goes through in overlapping segments.
                cuts = [(0, len(own))] if b - a > 1 or len(own) <= SEGMENT + length else [(i, min(len(own), i + SEGMENT + length - 1)) for i in range(0, len(own) - length + 1, SEGMENT)]
                for i, j in cuts:
                    owner, start, key, content = _anchors(own[i:j], ends if len(cuts) == 1 else np.array([0, j - i]), length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(docs[a:b][owner]), pa.array((start + i).astype(np.int32))], ["anchor", "content", "doc", "start"])

    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "text").mapInArrow(find, SPANS)


def _judged(spans: DataFrame, length: int) -> DataFrame:
    """doc, start, end, anchor: spans that repeat as a whole (anchor null) and those to be looked into."""
    shape = "doc long, start int, stop int, anchor long"

    def emit(rows: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        """Judge sorted rows that hold whole anchors, but for those at the ends of the task."""
        anchor = rows["anchor"] >> 7
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new = np.append(True, (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["content"][1:] != rows["content"][:-1]))
        group = np.cumsum(new_anchor) - 1
        kinds = np.bincount(group, weights=new)
        open_ends = np.zeros(len(kinds), dtype=bool)
        open_ends[0] |= first
        open_ends[-1] |= last
        at = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first span of this content
        same = (rows["doc"] == rows["doc"][at]) & (rows["start"] == rows["start"][at])
        look = new & ((kinds > 1) | open_ends)[group]
        take = look | ~same
        stop = rows["start"] + (rows["anchor"] & 127).astype(np.int32) + np.int32(length - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["doc"][take]), pa.array(rows["start"][take]), pa.array(stop[take]), pa.array(anchor[take], mask=~look[take])],
            ["doc", "start", "stop", "anchor"],
        )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("anchor", "<i8"), ("content", "<i8"), ("doc", "<i8"), ("start", "<i4")]
        held, first = np.zeros(0, dtype=kind), True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, dtype=kind)
            for i, (name, _) in enumerate(kind):
                rows[name] = batch.column(i).to_numpy()
            rows = np.concatenate((held, rows))
            anchor = rows["anchor"] >> 7
            whole = int(np.searchsorted(anchor, anchor[-1]))
            if not whole and len(rows) > CHUNK:  # one anchor fills the batch: go on as if a task ended here
                whole = len(rows)
                yield emit(rows, True, True)
                held, first = rows[:0], True
                continue
            if whole:
                yield emit(rows[:whole], first, False)
                first = False
            held = rows[whole:]
        if len(held):
            yield emit(held, first, True)

    order = ["anchor", "content", "doc", "start"]
    return spans.repartitionByRange("anchor", "content", "doc").sortWithinPartitions(*order).mapInArrow(judge, shape)


def _block(spans: pd.DataFrame, length: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Repeated windows (as runs of bytes) and the windows that are first of their content in this block."""
    sizes = spans["bytes"].map(len).to_numpy()
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.zeros(at[-1], dtype=np.uint8)
    for i, raw in zip(at.tolist(), spans["bytes"]):
        text[i : i + len(raw)] = np.frombuffer(raw, dtype=np.uint8) + np.uint8(1)  # no byte of UTF-8 is 255; 0 ends a span
    starts = suffix_array(text, length)
    owner = np.searchsorted(at, starts, side="right") - 1
    real = starts - at[owner] <= sizes[owner] - length
    starts, owner = starts[real], owner[real]
    words = words_at(text)
    same = common_prefix_reaches(starts, words, length)
    group = np.concatenate(([0], np.cumsum(~same))) if len(starts) else np.zeros(0, dtype=np.int64)
    doc, place = spans["doc"].to_numpy()[owner], spans["start"].to_numpy()[owner] + (starts - at[owner])
    by = np.lexsort((place, doc, group))
    starts, owner, group, doc, place = starts[by], owner[by], group[by], doc[by], place[by]
    head = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, dtype=bool)
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(group) else group
    repeat = (doc != doc[lead]) | (place != place[lead])
    cover = pd.DataFrame({"doc": doc[repeat], "start": place[repeat], "stop": place[repeat] + length})
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers("up", len(text)), out=sums[1:])
    own = starts[head]
    digest = (sums[own + length] - sums[own]) * powers("down", len(text))[own]
    twin = sum((mixed(words[own + k] + np.uint64(k)) for k in range(0, length - 7, 8)), words[own + length - 8])
    firsts = pd.DataFrame({"doc": doc[head], "start": place[head], "d1": mixed(digest).view(np.int64), "d2": mixed(twin).view(np.int64)})
    return _runs(cover), firsts


def _runs(cover: pd.DataFrame) -> pd.DataFrame:
    """Join overlapping stretches of each document."""
    cover = cover.sort_values(["doc", "start"], kind="stable")
    doc, start, stop = (cover[c].to_numpy() for c in ("doc", "start", "stop"))
    if not len(doc):
        return cover
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1]))  # all stretches have one length
    first = np.flatnonzero(new)
    return pd.DataFrame({"doc": doc[first], "start": start[first], "stop": stop[np.append(first[1:], len(doc)) - 1]})


def repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """doc (doc_id, null as the smallest number), start, stop: stretches of repeated bytes, which may overlap."""
    if not 0 < gram <= length or length - gram + 1 > 127:
        raise ValueError("a gram has at most length bytes and at least length - 126")
    judged = pin(_judged(_spans(documents, length, gram), length))
    whole = judged.where("anchor IS NULL").select("doc", "start", "stop")
    open_spans = judged.where("anchor IS NOT NULL")
    lots_of = max(1, -(-open_spans.count() // TOGETHER))
    many = pin(open_spans.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("anchor", F.lit(True).alias("hot")))
    dealt = open_spans.join(many, "anchor", "left")
    lists = dealt.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "anchor", "hot")).alias("spans"))
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text").join(lists, "doc")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw, found = (text.as_py() or "").encode(), spans.as_py()
                found = [s for s in found if s["stop"] <= len(raw)]
                columns = [pa.array([doc.as_py()] * len(found), pa.int64()), *[pa.array([s[k] for s in found], t) for k, t in (("start", pa.int32()), ("anchor", pa.int64()), ("hot", pa.bool_()))]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([raw[s["start"] : s["stop"]] for s in found], pa.binary())], ["doc", "start", "anchor", "hot", "bytes"])

    rows = texts.select("doc", "text", "spans").mapInArrow(cut, "doc long, start int, anchor long, hot boolean, bytes binary")
    rows = pin(rows) if many.count() else rows
    plain = rows.where("hot IS NULL").select("doc", "start", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(lots_of)).alias("lot"), F.lit(-1).cast("long").alias("part"))
    # Anchors with very many spans are told apart by what surrounds them.
    pieces = pin(_pieces(rows.where("hot"), length, gram))
    kept = pieces.groupBy("anchor", "content").agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    kept = pin(kept.select("anchor", "content", "f", "n", "bytes"))
    again = pieces.join(kept.where("n > 1").select("anchor", "content", "f"), ["anchor", "content"]).where(F.struct("doc", "start") != F.col("f"))
    again = again.select("doc", "start", (F.col("start") + F.length("bytes")).cast("int").alias("stop"))
    mixed_ones = pin(kept.groupBy("anchor").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), F.count("*").alias("n")).where("n > 1").select("anchor", "chunks"))
    part = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("f.doc", "f.start"), F.col("chunks"))).otherwise(F.lit(-1)).cast("long")
    lot = F.when(F.col("chunks") > 1, F.col("anchor")).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(lots_of)))
    close = kept.join(mixed_ones, "anchor").select("f.doc", "f.start", "bytes", lot.alias("lot"), part.alias("part"))

    def block(spans: pd.DataFrame) -> pd.DataFrame:
        spans = spans.drop_duplicates(["doc", "start", "bytes"])
        cover, firsts = _block(spans, length)
        out = cover.assign(d1=np.int64(0), d2=np.int64(0), first=False)
        if spans["part"].iloc[0] >= 0:
            firsts = firsts.assign(stop=firsts["start"] + length, first=True)
            out = pd.concat([out, firsts[out.columns]])
        return out

    found = pin(plain.unionByName(close).groupBy("lot", "part").applyInPandas(block, "doc long, start int, stop int, d1 long, d2 long, first boolean"))
    firsts = found.where("first")
    least = pin(firsts.groupBy("d1", "d2").agg(F.min(F.struct("doc", "start")).alias("m"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "m"))
    late = firsts.join(least, ["d1", "d2"]).where(F.struct("doc", "start") != F.col("m")).select("doc", "start", "stop")
    return whole.unionByName(again).unionByName(found.where("NOT first").select("doc", "start", "stop")).unionByName(late)


def _pieces(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Cut spans into pieces of ``PIECE`` windows by their distance from the anchor.

    All windows of a piece have ``length - PIECE + 1`` bytes in common, which
    make its new anchor; equal windows have equal distances and so meet again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, start, anchor, raw in zip(*(c.to_pylist() for c in batch.columns)):
                text = np.frombuffer(raw, dtype=np.uint8)
                n, windows = len(text), len(text) - length + 1
                sums = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers("up", n), out=sums[1:])
                hashes = mixed((sums[gram:] - sums[: n - gram + 1]) * powers("down", n)[: n - gram + 1]).view(np.int64) >> 7
                place = int(np.flatnonzero(hashes[: length - gram + 1] == anchor)[-1])  # the last one in the first window
                for number in range(max(0, place - windows + 1) // PIECE, place // PIECE + 1):
                    top = place - number * PIECE  # the window of this piece with the least distance
                    first, last = max(0, top - PIECE + 1), min(windows - 1, top)
                    common = raw[top : top - PIECE + 1 + length]
                    inside = raw[first : last + length]
                    name = hashlib.blake2b(b"%d %d " % (anchor, number) + common, digest_size=8).digest()
                    own = hashlib.blake2b(b"%d " % (top - first) + inside, digest_size=8).digest()
                    out.append((int.from_bytes(name, "little", signed=True), int.from_bytes(own, "little", signed=True), doc, start + first, inside))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "doc", "start", "bytes"])

    return rows.select("doc", "start", "anchor", "bytes").mapInArrow(cut, "anchor long, content long, doc long, start int, bytes binary")


def _ranks(documents: DataFrame) -> DataFrame | None:
    """Numbers for the pairs of doc_id and text, in order, if a doc_id has more than one text; else its own order serves."""
    ids = documents.select(F.col("doc_id").cast("long").alias("_id"))
    if ids.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # reads no text
        return None
    keys = documents.select(F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_hash"))
    several = keys.groupBy("_id").agg(F.min("_hash").alias("a"), F.max("_hash").alias("b")).where("a <> b")
    if several.isEmpty():
        return None
    return pin(numbered(keys.distinct(), [F.col("_id").asc_nulls_first(), F.col("_hash")], index="rank"))


def deduplicated(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK, with_kept: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans, kept_sha256 and, if asked, kept (binary).

    ``spans`` are the maximal removed runs as (start, end) in bytes of UTF-8,
    end exclusive. Matches never cross documents. Null and empty texts, and
    texts shorter than ``length``, lose nothing. Rows with one doc_id and
    text are one document, so equal rows get equal results and do not repeat
    each other; other texts of a doc_id are documents of their own, ordered by
    a hash of the text. A null doc_id comes before all others. Other columns are
    ignored.
    """
    ranks = _ranks(documents)
    if ranks is not None:
        own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("hash"))
        same = own["doc_id"].eqNullSafe(ranks["_id"]) & (own["hash"] == ranks["_hash"])
        told = pin(own.join(ranks, same).select(F.col("rank").alias("doc_id"), "text"))
        found = deduplicated(told, length, gram, chunk, with_kept).withColumnRenamed("doc_id", "rank")
        return found.join(ranks.select("rank", F.col("_id").alias("doc_id")), "rank").select("doc_id", *[c for c in found.columns if c != "rank"])
    stretches = repeats(documents, length, gram, chunk).groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("stretches"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text").join(stretches, "doc", "left")
    shape = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string" + ", kept binary" * with_kept
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                keep = np.zeros(len(raw) + 1, dtype=np.int32)
                for s in found.as_py() or ():
                    if s["start"] < len(raw):
                        keep[s["start"]] += 1
                        keep[min(s["stop"], len(raw))] -= 1
                gone = np.concatenate(([False], np.cumsum(keep)[:-1] > 0, [False]))
                edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
                left = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in edges]], [*[s for s, _ in edges], len(raw)])) if edges else raw
                for column, value in zip(out, (len(raw), len(raw) - len(left), [{"start": s, "end": e} for s, e in edges], hashlib.sha256(left).hexdigest(), left)):
                    column.append(value)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind), pa.array(out[3], pa.string())]
            columns += [pa.array(out[4], pa.binary())] if with_kept else []
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in shape.replace("start:int,end:int", "").split(", ")])

    return rows.select("doc_id", "text", "stretches").mapInArrow(cut, shape)
