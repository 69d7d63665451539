"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import decontaminate, language_crf, line_dedup, minhash_forest, packing
from tallyhouse.llm.expressions import text_key
from tallyhouse.llm.queries import prepared, table, vocabulary
from tallyhouse.session import pin

#: Documents whose words are less certain of their languages, in the mean, are rejected, and so are those without letters.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose words speak for no language.

    A text of several languages stays if its words are certain. The model
    learns from the documents' own labels. The null text goes; the empty table
    stays empty; without any label nothing is judged and all with letters stay.
    """
    prepared(spark)
    found = language_crf.identify(docs, keep=docs.columns)
    return found.where((F.col("n_words") > 0) & ((F.col("certainty") == 0) | (F.col("certainty") >= LEAST_SCORE))).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first occurrence of each line that is found in ten documents or more. n_chars follows the text.

    Documents that lose all their text leave: all of it stands in others.
    """
    prepared(spark)
    found = line_dedup.with_bitmaps(docs, spare_copies=True).withColumn("text", F.when(F.col("text").isNotNull(), line_dedup.kept_text(F.col("text"), F.col("keep_words"))))
    length = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(line_dedup.BLANKS)) == "")
    return found.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", length).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest doc_id.

    Rows are told apart by doc_id and text: equal rows stay once, other texts of
    one doc_id are documents of their own. A null doc_id comes after all others.
    Documents without words are in no group and stay.
    """
    prepared(spark)
    named = docs.withColumn("_row", F.xxhash64("doc_id", text_key(F.col("text"))))
    rows = named.select("_row", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_row").alias("rank"))
    found = minhash_forest.links(named.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "class_id").distinct()
    kept = found.join(rows, "_row").groupBy("class_id").agg(F.min("rank").alias("rank")).select(F.col("rank._row").alias("_row"))
    return named.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of ten words of a benchmark item.

    Null and empty texts hold none and stay, repeated rows go or stay together,
    and without documents or items nothing goes.
    """
    prepared(spark)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    hit = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_id")) & (text_key(docs["text"]) == F.col("_hash")), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of at most 4096 tokens.

    Null and empty texts are one piece of the end id, repeated rows are pieces
    of their own, and without documents there is none. The ids of a piece are
    those from ``start`` on, ``length`` of them, of its document's text.
    """
    prepared(spark)
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


def apart(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage over the columns of ``documents``; others travel in one struct, so that their names cannot meet the stage's own."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in DOCUMENTS]
        if not more:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.select(*DOCUMENTS, F.struct(*more).alias("_carried")), sf_dir)
        if "_carried" not in out.columns:
            return out
        return out.select(*[F.col(c) if c in DOCUMENTS else F.col("_carried")[c].alias(c) for c in docs.columns])

    return run_stage


#: Columns of the table; a stage but the last returns them, and others that came along.
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", apart(language_id)),
    ("line_dedup", apart(drop_lines)),
    ("ngram_jaccard", apart(one_of_each)),
    ("decontaminate", apart(drop_contaminated)),
    ("best_two_fit", pack),
]

#: SQL cannot train a model or tokenize; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
