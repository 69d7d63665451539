"""Session settings and lineage cutting shared by every plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive settings every plan relies on: small partitions are merged, skewed
# join partitions are split even where that costs one more exchange.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(name: str = "tallyhouse", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python line of every column call costs more than planning a wide rule set.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings without touching sizes the cluster owner chose."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def size_joins(spark: SparkSession) -> SparkSession:
    """Judge a table before a join by its rows, not by its files.

    Files of ids and few distinct values shrink twenty-fold and more: judged by
    their bytes, tables of a million rows are gathered on the driver to be sent
    around, several at once. What is really small is still sent around: the
    adaptive settings find that out from the measured size of the rows.
    """
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "25")
    return spark


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared folder of the cluster.

    The cluster names that folder in ``spark.checkpoint.dir``. A session on one
    machine may do without it and gets a private folder; on a cluster each
    executor would write to its own disk, so a missing setting is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="spark-tallyhouse-")
    return f"{root}/{purpose}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the shared folder and read it from there.

    The lineage is cut and survives lost executors. Unlike a checkpoint, the
    stored table keeps its size and lets later plans read only the columns they need.
    """
    path = scratch_dir(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
