"""Lines found in many documents, dropped from all of them.

Each line becomes a hash of its key. The hashes are dealt by range together
with the document, so a very frequent line spreads over many tasks, and sorted
inside each task by hash, document and position. One streaming pass marks the
first occurrence of a key in a document; the marks are summed to a number of
documents for each key. The result is not text but, for each document, a
bitmap of the lines to keep, compressed to the 64-line words that are not full.
Everything runs on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.expressions import ascii_lower, text_key
from tallyhouse.session import pin

#: A key of at least so many code points in at least so many documents goes.
MIN_CHARS, MIN_DOCS = 1, 10
BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """A null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(documents: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_hash, pos and 96 bits of hash of every line whose key is long enough."""
    lines = documents.select("doc_id", text_key(F.col("text")).alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_hash", "pos", ascii_lower(F.btrim("line", F.lit(BLANKS))).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))


def frequent_keys(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The hashes of keys found in at least ``min_docs`` documents, and that number. Rows with one doc_id are one document."""
    return _frequent(pin(_hashed(documents, min_chars)), min_docs)


def _frequent(hashed: DataFrame, min_docs: int) -> DataFrame:
    """``frequent_keys`` from stored hashes: dealing by range reads them twice, once for the bounds."""
    order = ["h", "g", "doc_id", "text_hash", "pos"]
    ranged = hashed.repartitionByRange("h", "g", "doc_id").sortWithinPartitions(*order)
    first = F.row_number().over(Window.partitionBy("h", "g", "doc_id").orderBy("text_hash", "pos")) == 1
    return ranged.withColumn("first", first).where("first").groupBy("h", "g").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def _spared(dropped: DataFrame) -> DataFrame:
    """The first occurrence of each key by doc_id (null first) and position."""
    return dropped.groupBy("h", "g").agg(F.min(F.struct("doc_id", "text_hash", "pos")).alias("f")).select("f.*")


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, spare_copies: bool = False) -> DataFrame:
    """doc_id, text_hash, n_dropped and keep_words for each document that loses lines.

    ``keep_words`` maps a word number w to 64 bits, bit i of which says whether
    line 64 w + i stays; words that are missing keep all their lines.
    Documents with equal doc_id and text share a row. A null doc_id is a
    document like any other; a null text has one empty line and keeps it.
    With ``spare_copies`` the first occurrence of each key stays where it is.
    """
    hashed = pin(_hashed(documents, min_chars))  # the texts are split and hashed once
    frequent = pin(_frequent(hashed, min_docs).select("h", "g"))
    bit, word = F.expr("shiftleft(1L, pos % 64)"), F.expr("CAST(pos DIV 64 AS INT)").alias("word")
    if spare_copies:
        dropped = pin(hashed.join(frequent, ["h", "g"]).dropDuplicates(["doc_id", "text_hash", "pos"]))
        marked = dropped.select("doc_id", "text_hash", word, bit.alias("hit"), F.lit(0).cast("long").alias("stays"))
        marked = marked.unionByName(_spared(dropped).select("doc_id", "text_hash", word, F.lit(0).cast("long").alias("hit"), bit.alias("stays")))
        words = marked.groupBy("doc_id", "text_hash", "word").agg(F.bit_or("hit").bitwiseAND(F.bitwise_not(F.bit_or("stays"))).alias("gone")).where("gone <> 0")
    else:
        words = hashed.join(frequent, ["h", "g"]).groupBy("doc_id", "text_hash", word).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("keep")))).alias("keep_words"),
    )


def with_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, spare_copies: bool = False) -> DataFrame:
    """All documents with their columns and n_lines, n_dropped, keep_words (null: keep all)."""
    bitmaps = keep_bitmaps(documents, min_chars, min_docs, spare_copies).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "n_dropped": "_dropped", "keep_words": "_keep"})
    found = documents.withColumn("_own", text_key(F.col("text")))
    joined = found.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    return joined.select(
        *[documents[c] for c in documents.columns],
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.col("_keep").alias("keep_words"),
    )


def kept_text(text: Column, keep_words: Column) -> Column:
    """The lines a bitmap keeps, joined again; a text without bitmap stays as it is, null as empty."""

    def stays(_: Column, i: Column) -> Column:
        word = F.try_element_at(keep_words, (i / 64).cast("int"))
        return F.coalesce(F.getbit(word, i % 64) == 1, F.lit(True))

    return F.when(keep_words.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.filter(lines_of(text), stays), "\n"))


ORACLE_SQL = """
WITH split AS (
    SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
    SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), judged AS (
    SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""
