"""Removal of rows whose retention period is over from a table partitioned by day or month."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import pin
from tallyhouse.streaming.audit import audit_records


def _last_day(period: str) -> date | None:
    """The last day of ``yyyy-MM-dd`` or ``yyyy-MM``."""
    try:
        if len(period) == 10:
            return date.fromisoformat(period)
        year, month = map(int, period.split("-"))
        return date(year + month // 12, month % 12 + 1, 1) - timedelta(days=1)
    except ValueError:
        return None


def purge(spark: SparkSession, path: str, period: str, days: int, today: date, holds: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Remove the periods that ended more than ``days`` days before ``today``, but no row that a hold protects.

    A period whose rows are all due is dropped by removing its folder; no row of
    it is read. Only the key column of due periods is read to find those with
    held keys; these are rewritten with their held rows alone. A period that is
    not yet over stays whole, as does one whose name is no date. NULL keys are not
    held. One writer at a time.

    Returns the audit record of the purge, one row.
    """
    table = spark.read.parquet(path)
    # One value for each stored period, taken from the names of the folders.
    periods = sorted({str(r[0]) for r in table.select(period).distinct().collect() if r[0] is not None})
    due = [p for p in periods if (end := _last_day(p)) and (today - end).days > days]
    mixed: list[str] = []
    if due and holds is not None:
        of_due = table.where(F.col(period).cast("string").isin(due))
        protected = of_due.join(holds.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")
        mixed = sorted(str(r[0]) for r in protected.select(period).distinct().collect())
        if mixed:
            kept = pin(protected.where(F.col(period).cast("string").isin(mixed)).select(table.columns))
            kept.repartitionByRange(period, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)
    dropped = [p for p in due if p not in mixed]
    folder = spark._jvm.org.apache.hadoop.fs.Path
    files = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for p in dropped:
        files.delete(folder(f"{path}/{period}={p}"), True)
    spark.catalog.refreshByPath(path)
    told = f"{len(dropped)} periods dropped, {len(mixed)} rewritten, older than {days} days on {today}"
    return audit_records(
        spark.range(1),
        event_id=F.uuid(),
        timestamp=F.current_timestamp(),
        action_type=F.lit("configuration_change"),
        resource_type=F.lit(path),
        decision=F.lit("allow"),
        reason_comment=F.lit(told),
        retention_period=F.lit(365),
    )
