"""Benchmark decontamination by winnowing.

A run of ``WINDOW`` words is shared exactly if it holds the same fingerprints:
of the hashes of ``GRAM`` words in a row, the smallest in each sliding window
of ``WINDOW - GRAM + 1`` is kept, so two texts with a shared run of ``WINDOW``
words or more keep a common hash inside it. Fingerprints of documents and
items are joined, and every hit is extended to the word windows around it,
which are then compared word by word with those of the items. Items shorter
than a window are looked up whole, by hashes of their own length.

Fingerprints and comparison fold the same words, A-Z alone: a fold that looks
at neighbouring letters, as that of a Greek final sigma, would lose hits.
Everything runs on DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.expressions import ascii_lower, let, text_key
from tallyhouse.session import pin

WINDOW, GRAM = 10, 5
#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text whose letters are lower-case already; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _each(count: Column, body) -> Column:
    """``body(i)`` for i from 1 to ``count``; an empty array for a count below 1."""
    numbers = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, body)


def gram_hashes(found: Column, gram: int) -> Column:
    return _each(F.size(found) - (gram - 1), lambda i: F.xxhash64(F.slice(found, i, gram)))


def _short(found: Column, length: int) -> Column:
    return _each(F.size(found) - (length - 1), lambda i: F.xxhash64(F.lit(length), F.slice(found, i, length)))


def fingerprints(found: Column, window: int, gram: int) -> Column:
    """Winnowed hashes: the smallest of each ``window - gram + 1`` neighbours."""
    span = window - gram + 1
    return let(gram_hashes(found, gram), lambda g: F.array_distinct(_each(F.size(g) - (span - 1), lambda i: F.array_min(F.slice(g, i, span)))))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, n (words of a window) and words: the distinct windows of every item with words."""
    found = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = found.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at"))
    return starts.select("item", "n", F.array_join(F.expr("slice(w, at, n)"), " ").alias("words")).distinct()


def benchmark_fingerprints(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    found = benchmark.select(words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    whole = F.array(F.xxhash64(F.size("w"), F.col("w")))
    marks = F.when(F.size("w") < window, whole).otherwise(fingerprints(F.col("w"), window, gram))
    return found.select(F.explode(marks).alias("mark")).distinct()


def short_lengths(benchmark: DataFrame, window: int = WINDOW) -> list[int]:
    """The word counts below ``window`` that occur among the items: fewer than ``window`` numbers."""
    n = F.size(words(ascii_lower(F.col("text"))))
    return sorted(r[0] for r in benchmark.select(n.alias("n")).where(F.col("n").between(1, window - 1)).distinct().collect())


def _marks(found: Column, lengths: Sequence[int], window: int, gram: int) -> Column:
    """All hashes by which a document can meet an item."""
    long = F.when(F.size(found) >= window, fingerprints(found, window, gram)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(long, *[_short(found, n) for n in lengths]))


def _candidates(lengths: Sequence[int], window: int, gram: int) -> Column:
    """Extend the matching fingerprints of a row to every word window that holds one: at (from 1), n, words."""
    span, matched = window - gram + 1, F.col("matched")

    def windows(exact: Column) -> Column:
        def tried(starts: Column, n: int) -> Column:
            return F.transform(starts, lambda s: F.struct(s.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(exact, s, n), " ").alias("words")))

        def numbers(n: int) -> Column:
            return _each(F.size(exact) - (n - 1), lambda i: i)

        long = let(gram_hashes(exact, gram), lambda g: tried(F.filter(numbers(window), lambda s: F.arrays_overlap(F.slice(g, s, span), matched)), window))
        def whole(n: int) -> Column:
            return tried(F.filter(numbers(n), lambda s: F.array_contains(matched, F.xxhash64(F.lit(n), F.slice(exact, s, n)))), n)

        return F.concat(long, *[whole(n) for n in lengths])

    return let(words(ascii_lower(F.col("text"))), windows)


def _merged(runs: Column) -> Column:
    """Join overlapping and touching runs, which come in ascending order."""

    def add(done: Column, run: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= run["start"]), longer).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(runs, F.array().cast("array<struct<start:int,end:int>>"), add)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, spans, items.

    A document word inside any occurrence of an item's window of ``window``
    words (of a shorter item: of all its words) is hit. ``spans`` are the hit
    runs as (start, end) word numbers from 0, end exclusive; ``items`` the ids,
    as sorted strings, of items with occurring windows (a null id is the empty
    string). Null and empty texts have no words; an item without words has no
    window. Repeated rows get equal results. Other columns are ignored.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram has from 1 to window words")
    lengths = short_lengths(benchmark, window)
    own = documents.select("doc_id", "text", text_key(F.col("text")).alias("text_hash"))
    marks = pin(
        own.select(
            "doc_id", "text_hash",
            let(words(ascii_lower(F.col("text"))), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _marks(w, lengths, window, gram).alias("marks"))).alias("f"),
        ).select("doc_id", "text_hash", "f.n_words", "f.marks")
    )
    targets = pin(benchmark_fingerprints(benchmark, window, gram))
    spread = marks.select("doc_id", "text_hash", F.explode("marks").alias("mark"))
    # Few documents match; their list of matching fingerprints is no longer than they are.
    matched = pin(spread.join(targets, "mark", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("mark").alias("matched")))
    matched = matched.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    candidates = own.join(matched, same).select("doc_id", "text_hash", _candidates(lengths, window, gram).alias("c"))
    tried = candidates.select("doc_id", "text_hash", F.inline("c")).distinct()
    theirs = pin(benchmark_windows(benchmark, window))
    hits = pin(tried.join(theirs.select("words").distinct(), "words", "left_semi"))
    runs = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct((F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.col("n")).alias("end")))).alias("runs"))
    runs = runs.select("doc_id", "text_hash", _merged(F.col("runs")).alias("spans"))
    items = hits.select("doc_id", "text_hash", "words").distinct().join(theirs.select("words", "item"), "words")
    items = items.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    both = runs.unionByName(items, allowMissingColumns=True).groupBy("doc_id", "text_hash")
    found = both.agg(F.first("spans", ignorenulls=True).alias("spans"), F.first("items", ignorenulls=True).alias("items"))
    found = found.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    out = marks.select("doc_id", "text_hash", "n_words").join(found, same, "left")
    covered = F.aggregate(F.coalesce("spans", F.array()), F.lit(0), lambda total, s: total + (s["end"] - s["start"]))
    return out.select("doc_id", "text_hash", "n_words", covered.cast("long").alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


ORACLE_SQL = f"""
WITH items AS (
    SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark
), starts AS (
    SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM items WHERE len(w) > 0
), theirs AS (
    SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM starts
), docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), tried AS (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM theirs) WHERE len(w) >= n
), hits AS (
    SELECT doc_id, s, t.n, item FROM (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win FROM tried) t JOIN theirs USING (n, win)
), hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""
