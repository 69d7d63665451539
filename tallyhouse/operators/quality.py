"""Declared validation rules, row disposition, control totals, contracts and file gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions import as_col, holds, is_blank
from tallyhouse.operators.relational import with_member_flag, with_repeat_flag
from tallyhouse.sources.intake import DATE_TEXT

# Dispositions from mildest to strictest (fixed values).
ACTIONS = ("Accept", "Flag", "Deduplicate", "Quarantine", "Reject")


@dataclass(frozen=True)
class Check:
    """A declared rule on one or more fields."""

    name: str
    fields: tuple[str, ...]
    kind: str
    action: str = "Quarantine"
    value: Any = None
    reference: DataFrame | None = None

    @property
    def flag(self) -> str:
        return f"_bad_{self.name}"


def _violation(check: Check) -> Column:
    """The predicate under which a row breaks a rule that needs no other row."""
    field, value = F.col(check.fields[0]), check.value
    if check.kind == "NOT_NULL":
        return is_blank(field.cast("string"))
    if check.kind == "REGEX":
        return ~field.rlike(value)
    if check.kind == "DATE_VALID":
        text = field.cast("string")
        return text.isNotNull() & (~text.rlike(DATE_TEXT) | text.try_cast("date").isNull())
    if check.kind == "EXPRESSION":
        return ~F.expr(value)
    if check.kind == "IN_LIST":
        return ~field.isin(list(value))
    if check.kind == "GREATER_THAN":
        return ~(field > value)
    if check.kind == "GREATER_THAN_EQUAL":
        return ~(field >= value)
    if check.kind == "IN_RANGE":
        return ~field.between(*value)
    raise ValueError(f"unknown rule kind {check.kind}")


def mark_violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One boolean column per rule.

    Row rules are plain predicates; foreign keys are one left join each against
    distinct keys; uniqueness is a counted key set joined back.
    """
    for check in checks:
        if check.kind == "FOREIGN_KEY":
            member = f"_member_{check.name}"
            df = with_member_flag(df, check.fields[0], check.reference, member)
            df = df.withColumn(check.flag, F.col(check.fields[0]).isNotNull() & ~F.col(member)).drop(member)
        elif check.kind in ("UNIQUE", "UNIQUE_PER_PERIOD"):
            df = with_repeat_flag(df, check.fields, check.flag)
    simple = [c for c in checks if c.kind not in ("FOREIGN_KEY", "UNIQUE", "UNIQUE_PER_PERIOD")]
    return df.select("*", *[holds(_violation(c)).alias(c.flag) for c in simple])


def violations(df: DataFrame, checks: Sequence[Check], key: Sequence[str]) -> DataFrame:
    """Long list of broken rules per row."""
    marked = mark_violations(df, checks)
    entries = [
        F.when(F.col(c.flag), F.struct(F.lit(c.name).alias("rule_name"), F.lit(c.kind).alias("check_type"), F.lit(c.action).alias("action")))
        for c in checks
    ]
    return marked.select(*key, F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))


def with_disposition(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The strictest action among the broken rules of each row, as ``disposition``."""
    marked = mark_violations(df, checks)
    rank = F.greatest(F.lit(0), *[F.when(F.col(c.flag), F.lit(ACTIONS.index(c.action))).otherwise(F.lit(0)) for c in checks])
    label = F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), rank + 1)
    return marked.withColumn("disposition", label).drop(*[c.flag for c in checks])


def route(df: DataFrame, checks: Sequence[Check], path: str) -> None:
    """Write rows to one folder per disposition in a single pass."""
    with_disposition(df, checks).write.mode("overwrite").partitionBy("disposition").parquet(path)


def control_totals(df: DataFrame, totals: dict[str, str]) -> DataFrame:
    """Declared metric expressions over one table as (name, actual) rows."""
    row = df.agg(*[F.expr(rule).cast("double").alias(name) for name, rule in totals.items()])
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("total_name"), F.col(n).alias("actual")) for n in totals]))
    )


def compare_totals(actual: DataFrame, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Actual against delivered totals; a total missing on either side does not pass."""
    return actual.join(expected, "total_name", "full").select(
        "total_name", "expected", "actual",
        F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tolerance, F.lit(False)).alias("passed"),
    )


@dataclass(frozen=True)
class FieldContract:
    name: str
    type: str
    required: bool = False
    unique: bool = False
    allowed: tuple[str, ...] = ()
    minimum: float | None = None


def contract_report(df: DataFrame, contract: Sequence[FieldContract]) -> DataFrame:
    """Per declared field: type match and counts of missing, repeated, unlisted and too small values."""
    types = dict(df.dtypes)
    present = [f for f in contract if f.name in types]
    rows = []
    for field in present:
        col = F.col(field.name)
        rows.append(
            F.struct(
                F.lit(field.name).alias("field"),
                F.lit(types[field.name] == field.type).alias("type_ok"),
                (F.count(F.when(is_blank(col.cast("string")), 1)) if field.required else F.lit(0).cast("bigint")).alias("missing"),
                (F.count(F.when(~col.isin(list(field.allowed)), 1)) if field.allowed else F.lit(0).cast("bigint")).alias("not_allowed"),
                (F.count(F.when(col < field.minimum, 1)) if field.minimum is not None else F.lit(0).cast("bigint")).alias("below_minimum"),
            )
        )
    report = df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))
    repeats = None
    for field in (f for f in present if f.unique):
        extra = df.where(F.col(field.name).isNotNull()).groupBy(field.name).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).alias("repeated")
        ).select(F.lit(field.name).alias("field"), "repeated")
        repeats = extra if repeats is None else repeats.unionByName(extra)
    if repeats is None:
        report = report.withColumn("repeated", F.lit(0).cast("bigint"))
    else:
        report = report.join(F.broadcast(repeats), "field", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))
    absent = [f.name for f in contract if f.name not in types]
    if absent:
        lost = df.sparkSession.createDataFrame([(n,) for n in absent], "field string").selectExpr(
            "field", "false as type_ok", "0L as missing", "0L as not_allowed", "0L as below_minimum", "0L as repeated"
        )
        report = report.unionByName(lost)
    return report.select("field", "type_ok", "missing", "repeated", "not_allowed", "below_minimum")


# Delivery file names per source category (fixed values).
FILE_NAMES = {
    "HRIS / Employee Master": r"^jisr_employee_master_\d{8}\.csv$",
    "Payroll": r"^netsuite_payroll_ledger_\d{6}\.xlsx$",
    "Attendance": r"^zk_attendance_logs_\d{8}\.csv$",
    "Government / Compliance": r"^gosi_compliance_status_\d{8}\.csv$",
    "Employee Relations / Case Management": r"^er_sharepoint_log_\d{8}\.csv$",
    "Recruitment / Workforce Planning": r"^lever_recruitment_reqs_\d{8}\.csv$",
    "Talent / Performance / Learning": r"^successfactors_talent_\d{8}\.xlsx$",
    "Data Quality / Command Center Metadata": r"^command_center_audit_\d{8}\.csv$",
}


def gate_files(names: DataFrame, column: str, patterns: dict[str, str] = FILE_NAMES) -> DataFrame:
    """Assign each delivered file to the source whose name pattern it meets, or quarantine it."""
    category = F.coalesce(*[F.when(as_col(column).rlike(p), F.lit(c)) for c, p in patterns.items()])
    return names.withColumn("source_category", category).withColumn(
        "gate", F.when(category.isNull(), "Quarantine File").otherwise("Accept")
    )


def delivered_files(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and time of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("delivered_at"))


def gate_delivery(spark: SparkSession, folder: str, patterns: dict[str, str] = FILE_NAMES) -> DataFrame:
    """The gate on the files a source has put into a folder."""
    return gate_files(delivered_files(spark, folder), "file_name", patterns)
