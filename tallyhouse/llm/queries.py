"""The operators as queries over the given tables."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    automaton_search,
    conversation_repair,
    decontaminate,
    embedding_graph,
    language_crf,
    line_dedup,
    minhash_forest,
    packing,
    piecewise_hash,
    reshard,
    suffix_dedup,
    token_counts,
    token_files,
)
from tallyhouse.session import pin, scratch_dir, tune

#: Rows of an Arrow batch: texts can be long.
BATCH_ROWS = "1000"


_SHIPPED: set[str] = set()


def prepared(spark: SparkSession) -> SparkSession:
    """Set the adaptive settings and send this package's code to the executors, once for each application."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="spark-code-")  # of the driver, which serves the archive to the executors
        copy = Path(folder, "code", package.name)
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", copy.parent))
        _SHIPPED.add(context.applicationId)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(spark, path, with_ids=False)


def op2_language_crf(spark: SparkSession, folder: str) -> DataFrame:
    found = language_crf.identify(table(spark, folder, "documents"))
    return found.select("doc_id", language_crf.held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_switches")


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_embedding_graph(spark: SparkSession, folder: str) -> DataFrame:
    found, rows = embedding_graph.links(table(spark, folder, "embeddings"))
    found = pin(found)
    return found.withColumn("audited_recall", F.lit(embedding_graph.audit(rows, found)))


def op6_reshard(spark: SparkSession, folder: str) -> DataFrame:
    """From 32 shards by source, which are very uneven, to 40 of equal bytes."""
    documents = table(spark, folder, "documents").select("doc_id", "text", F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(32)).cast("int").alias("old"))
    resharded, changed = reshard.reshard(documents, "old", 40)
    path = scratch_dir(spark, "shards")
    reshard.rewrite(resharded, changed, path)
    rows = reshard.read_shards(spark, path, resharded.schema).unionByName(resharded.where(~F.col("_shard").isin(changed)))
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "doc_id",
        (F.octet_length(text).cast("long") + reshard.OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("_old").alias("old_shard"),
    )


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path, separator = scratch_dir(spark, "flat-tokens"), 50256
    token_counts.write_flat(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"), separator)
    counted = token_counts.count_tokens(token_counts.flat_blocks(spark, path), separator)
    return token_counts.named_counts(counted, token_counts.flat_names(spark, path)).select("doc_id", "shard", "ordinal", "start", "n_tokens")


def op8_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset")
    )


def op9_minhash_forest(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_forest.links(table(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.with_bitmaps(table(spark, folder, "documents"))
    kept = line_dedup.kept_text(F.col("text"), F.col("keep_words"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256"))


def op11_automaton_search(spark: SparkSession, folder: str) -> DataFrame:
    return automaton_search.search(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    repaired, report = conversation_repair.repair(conversation_repair.damaged(conversations))
    names = conversation_repair.rows_of(conversations)
    found = names.join(report.drop("conv_id"), "key", "left").join(conversation_repair.digests(repaired), "key", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_piecewise_hash(spark: SparkSession, folder: str) -> DataFrame:
    return piecewise_hash.fingerprints(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_language_crf": op2_language_crf,
    "op3_decontaminate": op3_decontaminate,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_embedding_graph": op5_embedding_graph,
    "op6_reshard": op6_reshard,
    "op7_token_counts": op7_token_counts,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_minhash_forest": op9_minhash_forest,
    "op10_line_dedup": op10_line_dedup,
    "op11_automaton_search": op11_automaton_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_piecewise_hash": op13_piecewise_hash,
}

#: Checking SQL where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_automaton_search": automaton_search.ORACLE_SQL,
}
