"""Ranked lexical search by an Aho-Corasick scan of whole texts, without an index of the documents.

The terms of the searched items, each between two boundary marks, make up one
automaton that every task holds. A text is folded to terms with one mark between
neighbours; the automaton then reports every occurrence of every term in one
pass. A first scan of the documents adds up how many hold each term, a second
counts again, scores each document for all items that its terms map to, and
keeps each task's best. Items are dealt into blocks of bounded size, so the
automaton is small however many items there are; documents are scanned anew for
each block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tallyhouse.llm.ordering import numbered
from tallyhouse.session import pin

#: Digits, letters and every byte of a non-ASCII character belong to terms; A-Z become a-z, all else a mark.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
MARK = b" "
#: Bytes of item texts of a block, and bytes of a text that are decoded at once.
BLOCK_BYTES, CHUNK = 8 << 20, 1 << 20
#: Scores held at once: documents times items.
CELLS = 1 << 21


def folded(text: str | None) -> bytes:
    """The terms of a text in lower case, one mark or more between them and at both ends."""
    return MARK + (text or "").encode("utf-8", "surrogatepass").translate(FOLDED) + MARK


def chunks(marked: bytes) -> Iterator[str]:
    """Pieces of a folded text that end and begin at marks; a mark at a cut is in both."""
    at = 0
    while at < len(marked) - 1:
        end = marked.find(MARK, min(at + CHUNK, len(marked) - 1))
        yield marked[at : end + 1].decode("utf-8", "surrogatepass")
        at = end


def term_count(marked: bytes) -> int:
    inside = np.frombuffer(marked, dtype=np.uint8) != 0x20
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


class Items:
    """Terms of a block of items and, for each term, the items that hold it and how often."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[str, int] = {}
        postings: list[list[tuple[int, int]]] = []
        for item, text in enumerate(texts):
            for term, n in sorted(Counter(folded(text).decode("utf-8", "surrogatepass").split(" ")).items()):
                if term:
                    if numbers.setdefault(term, len(postings)) == len(postings):
                        postings.append([])
                    postings[numbers[term]].append((item, n))
        self.terms, self.n_items = list(numbers), len(texts)
        self.first = np.cumsum([0, *map(len, postings)])
        flat = np.array([x for own in postings for x in own], dtype=np.int64).reshape(-1, 2)
        self.items, self.repeats = flat[:, 0], flat[:, 1]

    def score(self, documents: np.ndarray, terms: np.ndarray, values: np.ndarray, n_documents: int) -> np.ndarray:
        """Documents x items: each found term's value in its document, summed over the items that hold it."""
        sizes = np.diff(self.first)[terms]
        starts = np.repeat(self.first[terms] - np.cumsum(sizes) + sizes, sizes)
        at = starts + np.arange(len(starts))
        scores = np.zeros(n_documents * self.n_items, dtype=np.int64)
        np.add.at(scores, np.repeat(documents, sizes) * self.n_items + self.items[at], np.repeat(values, sizes) * self.repeats[at])
        return scores.reshape(n_documents, self.n_items)


@lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        found.add_word(f" {term} ", number)
    found.make_automaton()
    return found


def occurrences(terms: tuple[str, ...], marked: bytes) -> Counter:
    """How often each term occurs in a folded text."""
    found: Counter = Counter()
    if terms:
        automaton = _automaton(terms)
        for piece in chunks(marked):
            found.update(number for _, number in automaton.iter(piece))
    return found


COUNTS = StructType([StructField("term", IntegerType()), StructField("n", LongType()), StructField("total", LongType())])


def term_statistics(documents: DataFrame, terms: tuple[str, ...]) -> tuple[int, int, np.ndarray]:
    """Over all documents: how many have a term, all their terms, and for each of ``terms`` how many documents hold it."""
    held = documents.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, n_documents, n_terms = np.zeros(len(held.value), dtype=np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0):
                marked = folded(text.as_py())
                n = term_count(marked)
                n_documents, n_terms = n_documents + (n > 0), n_terms + n
                holding[list(occurrences(held.value, marked))] += 1
        some = np.flatnonzero(holding)
        rows = {"term": pa.array([-1, *some.tolist()], pa.int32()), "n": pa.array([n_documents, *holding[some].tolist()]), "total": pa.array([n_terms, *[0] * len(some)])}
        yield pa.RecordBatch.from_pydict(rows)

    df = np.zeros(len(terms), dtype=np.int64)
    n_documents = n_terms = 0
    # A row for each term of the block at most.
    for row in documents.select("text").mapInArrow(count, COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        if row["term"] < 0:
            n_documents, n_terms = row["n"], row["total"]
        else:
            df[row["term"]] = row["n"]
    held.unpersist()
    return n_documents, n_terms, df


def weights(n_documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def length_factor(n: int, n_documents: int, n_terms: int) -> int:
    """The m of a document of n terms: 100 at mean length."""
    return 75 + 25 * n * n_documents // n_terms


class Best:
    """The best documents of each item so far: highest score, then smallest doc_id (null last)."""

    def __init__(self, n_items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(n_items)], np.ones(n_items, dtype=np.int64)

    def add(self, ids: list[int | None], scores: np.ndarray) -> None:
        documents, items = np.nonzero(scores >= self.least)
        found = scores[documents, items].tolist()
        for d, i, s in zip(documents.tolist(), items.tolist(), found):
            self.rows[i].append((-s, ids[d] is None, ids[d] or 0))
        for i in np.unique(items).tolist():
            if len(self.rows[i]) > self.k:
                self.rows[i] = sorted(self.rows[i])[: self.k]
                self.least[i] = -self.rows[i][-1][0]


def _block_best(documents: DataFrame, items: Items, k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the k best of each task for each item, which hold the k best of all."""
    terms = tuple(items.terms)
    n_documents, n_terms, df = term_statistics(documents, terms)
    # The block's terms, postings and weights: bounded by BLOCK_BYTES of text.
    held = documents.sparkSession.sparkContext.broadcast((terms, items, weights(n_documents, df)))
    lot = max(1, CELLS // max(1, items.n_items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, items, weight = held.value
        best = Best(items.n_items, k)
        ids, at, found, tf, length = [], [], [], [], []

        def judge() -> None:
            d, t, n = (np.array(x, dtype=np.int64) for x in (at, found, tf))
            m = np.array(length, dtype=np.int64)[d]
            best.add(ids, items.score(d, t, weight[t] * (1_000_000_000 * n // (1000 * n + 12 * m)), len(ids)))
            for x in (ids, at, found, tf, length):
                x.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                marked = folded(text.as_py())
                n = occurrences(terms, marked)
                if n:
                    at += [len(ids)] * len(n)
                    found += n.keys()
                    tf += n.values()
                    length.append(length_factor(term_count(marked), n_documents, n_terms))
                    ids.append(doc_id)
                    if len(ids) == lot or len(at) >= CELLS:
                        judge()
        if ids:
            judge()
        rows = [(i, None if none else x, -s) for i, own in enumerate(best.rows) for s, none, x in own]
        for a in range(0, len(rows), 10_000):
            part = list(zip(*rows[a : a + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["item", "doc_id", "score"])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return found.mapInArrow(search, "item int, doc_id long, score long")


def search(spark: SparkSession, documents: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` its ``k`` best documents with a score above 0.

    Equal scores are ordered by doc_id, null last. Each row of ``items`` is an
    item of its own, also with a null or repeated item_id. Null and empty texts
    have no terms: such an item has no result, such a document is never found.
    Rows with one doc_id are documents of their own. Without documents or items
    the result is empty. Other columns are left out.

    The driver gets the items of one block and one number for each of their terms.
    """
    rows = items.select("item_id", "text").withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))) + 64).withColumn("salt", F.monotonically_increasing_id())
    rows = pin(numbered(rows, ["item_id", "salt"], running="bytes", total="before").select("item_id", "text", "row_index", F.expr(f"before DIV {block_bytes}").alias("block")))
    rows_of_blocks = rows.groupBy("block").agg(F.count("*").alias("n")).orderBy("block")
    found = None
    for block in [row["block"] for row in rows_of_blocks.toLocalIterator()]:
        own = rows.where(F.col("block") == block).orderBy("row_index").collect()
        first = own[0]["row_index"]
        best = _block_best(documents, Items([r["text"] for r in own]), k).withColumn("row_index", F.col("item") + F.lit(first)).drop("item")
        best = pin(best)  # k rows for each item and task
        found = best if found is None else found.unionByName(best)
    if found is None:
        return rows.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).where("false")
    order = Window.partitionBy("row_index").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return rows.select("item_id", "row_index").join(ranked, "row_index").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sizes AS (
    SELECT r, doc_id, len(terms) AS n FROM texts WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes
), wanted AS (
    SELECT i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), asked AS (
    SELECT i, item_id, term, count(*) AS repeats FROM wanted GROUP BY ALL
), tfs AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals
), scored AS (
    SELECT i, item_id, s.r, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l)))) AS BIGINT) AS score
    FROM asked JOIN tfs USING (term) JOIN weighed USING (term) JOIN sizes s ON s.r = tfs.r, totals
    GROUP BY ALL HAVING score > 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
