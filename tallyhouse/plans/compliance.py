"""Nationalisation, document and government-platform views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_blank, is_filled, money_text, percent, tally
from tallyhouse.functions.columns import EXPIRY_BUCKETS, expiry_bucket
from tallyhouse.operators.relational import side_by_side
from tallyhouse.operators.rules import flag_rows, stack
from tallyhouse.plans.texts import COMPLIANCE
from tallyhouse.plans.warehouse import Warehouse, rule_from, view

PLATFORM = (
    "qiwa_status", "gosi_status", "mudad_status", "contract_authenticated", "gosi_salary", "payroll_basic_salary",
    "occupation_code", "occupation_match_status", "work_permit_expiry", "iqama_expiry", "insurance_status",
)


def employee_class(known: Column, status: Column) -> Column:
    """Master-data class of a linked person."""
    return (
        F.when(known.isNull(), "Unknown Employee")
        .when(status.isin("Active", "Inactive", "Terminated"), F.concat(status, F.lit(" Employee")))
        .otherwise("Unknown Status Employee")
    )


def _national() -> Column:
    return F.col("is_saudi") & is_filled("nationality")


def _foreign() -> Column:
    return ~F.col("is_saudi") & is_filled("nationality")


def _unclear() -> Column:
    return is_blank("nationality") | F.col("is_saudi").isNull()


@view("base_government_platform_records")
def government_platform_records(wh: Warehouse) -> DataFrame:
    people = wh.view("base_employees_deduplicated").select(
        F.col("employee_id").alias("_id"), "employee_name", F.col("status").alias("employee_status"),
        "is_saudi", "nationality", "project", "department", "cost_center",
    )
    rows = wh.table("compliance").where(F.col("period") == wh.compliance_month.label).select("employee_id", "period", *PLATFORM)
    return (
        rows.join(people, F.col("employee_id") == F.col("_id"), "left")
        .withColumn("record_classification", employee_class(F.col("_id"), F.col("employee_status")))
        .drop("_id")
    )


@view("base_compliance_current")
def compliance_current(wh: Warehouse) -> DataFrame:
    """Every active employee with the platform record of the report period, if any."""
    people = wh.view("base_active_workforce").select(
        "employee_id", "employee_name", "nationality", "is_saudi", "company", "department", "project", "cost_center", "job_title", "employment_type"
    )
    rows = wh.table("compliance").where(F.col("period") == wh.compliance_month.label).select("employee_id", *PLATFORM)
    return people.join(rows, "employee_id", "left")


@view("base_saudization_population")
def saudization_population(wh: Warehouse) -> DataFrame:
    def flag(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    return wh.view("base_active_workforce").select(
        "employee_id", "employee_name", "nationality", "is_saudi", "project", "department",
        flag(_national()).alias("saudi_count"),
        flag(_foreign()).alias("non_saudi_count"),
        flag(_unclear()).alias("missing_nationality_count"),
    )


@view("base_government_status")
def government_status(wh: Warehouse) -> DataFrame:
    return wh.view("base_compliance_current").select(
        "employee_id", "employee_name", "is_saudi", "gosi_status", F.col("mudad_status").alias("wps_status"), "gosi_salary", "payroll_basic_salary",
        F.col("gosi_status").isNotNull().cast("int").alias("has_gosi_source"),
        F.col("mudad_status").isNotNull().cast("int").alias("has_wps_source"),
    )


@view("base_document_expiry")
def document_expiry_base(wh: Warehouse) -> DataFrame:
    anchor = F.lit(wh.compliance_month.end)
    return wh.view("base_compliance_current").where(_foreign()).select(
        "employee_id", "employee_name", "is_saudi", "iqama_expiry", "work_permit_expiry",
        expiry_bucket("iqama_expiry", anchor).alias("iqama_bucket"),
        expiry_bucket("work_permit_expiry", anchor).alias("work_permit_bucket"),
    )


@view("mart_compliance_exceptions")
def compliance_exceptions(wh: Warehouse) -> DataFrame:
    def rule(issue, when, **slots):
        return rule_from(COMPLIANCE, issue, when, **slots)

    def other_than(column: str, good: str) -> Column:
        return F.col(column).isNull() | (F.col(column) != good)

    gosi, basic = F.col("gosi_salary"), F.col("payroll_basic_salary")
    iqama, permit = F.col("iqama_bucket"), F.col("work_permit_bucket")
    return stack(
        flag_rows(
            wh.view("base_compliance_current"),
            [
                rule("Missing GOSI Status Record", F.col("gosi_status").isNull() & F.lit(wh.rules.has_gosi_source)),
                rule("Not Registered in GOSI", F.col("gosi_status") != "Registered"),
                rule("Missing WPS Record", F.col("mudad_status").isNull() & F.lit(wh.rules.has_wps_source)),
                rule("Missing Project assignment", is_blank("project")),
                rule("Missing Department assignment", is_blank("department")),
                rule("Missing Cost Center assignment", is_blank("cost_center")),
                rule("Missing Qiwa Contract", other_than("qiwa_status", "Active")),
                rule("Contract Not Authenticated", ~F.col("contract_authenticated")),
                rule("GOSI Salary Mismatch", gosi != basic, gosi_salary=money_text(gosi), basic=money_text(basic)),
                rule("Missing Salary Info", gosi.isNull() | basic.isNull()),
                rule("Occupation Mismatch", other_than("occupation_match_status", "Matched")),
                rule("Insurance Inactive", other_than("insurance_status", "Active")),
                rule("Missing Nationality", _unclear()),
            ],
            "employee_id",
            "employee_name",
        ),
        flag_rows(
            wh.view("base_government_platform_records"),
            [
                rule(
                    "WPS Record for Inactive Employee",
                    (F.col("record_classification") != "Active Employee") & F.col("mudad_status").isNotNull(),
                    employee_status=F.coalesce("employee_status", F.lit("Unknown")),
                )
            ],
            "employee_id",
            "employee_name",
        ),
        flag_rows(
            wh.view("base_document_expiry"),
            [
                rule("Missing Iqama Expiry Date", iqama == "missing_date"),
                rule("Expired Iqama", iqama == "expired"),
                rule("Iqama Expiring Soon", iqama == "0_30"),
                rule("Missing Work Permit Expiry Date", permit == "missing_date"),
                rule("Expired Work Permit", permit == "expired"),
                rule("Work Permit Expiring Soon", permit == "0_30"),
            ],
            "employee_id",
            "employee_name",
        ),
    )


def _population_counts() -> list[Column]:
    return [
        tally(_national()).alias("saudi_headcount"),
        tally(_foreign()).alias("non_saudi_headcount"),
        tally(_unclear()).alias("employees_missing_nationality"),
    ]


def _quota() -> Column:
    return percent("saudi_headcount", F.col("saudi_headcount") + F.col("non_saudi_headcount"))


@view("mart_compliance_kpis")
def compliance_kpis(wh: Warehouse) -> DataFrame:
    iqama, permit = F.col("iqama_bucket"), F.col("work_permit_bucket")
    row = side_by_side(
        wh.view("base_active_workforce").agg(*_population_counts()),
        wh.view("base_document_expiry").agg(
            tally(iqama == "0_30").alias("iqamas_expiring_30"),
            tally(permit == "0_30").alias("work_permits_expiring_30"),
            tally(iqama == "expired").alias("iqamas_expired"),
            tally(permit == "expired").alias("work_permits_expired"),
        ),
        wh.view("base_compliance_current").agg(
            tally(F.col("gosi_status").isNull() | (F.col("gosi_status") != "Registered")).alias("gosi_missing_count"),
            tally(F.col("mudad_status").isNull() | (F.col("mudad_status") != "Compliant")).alias("wps_exception_count"),
        ),
        wh.number_of_issues("mart_compliance_exceptions", "compliance_exception_count"),
    )
    return row.select(
        "saudi_headcount", "non_saudi_headcount", "employees_missing_nationality", _quota().alias("saudization_pct"),
        "iqamas_expiring_30", "work_permits_expiring_30", "iqamas_expired", "work_permits_expired",
        "gosi_missing_count", "wps_exception_count", "compliance_exception_count",
    )


@view("mart_saudization_summary")
def saudization_summary(wh: Warehouse) -> DataFrame:
    """Quota of the last periods: as-of populations for earlier month ends, the active workforce now."""
    month = wh.compliance_month
    ends = [m.end for m in wh.months_before("compliance", "period", month)]
    alive = F.filter(
        F.array(*[F.lit(d) for d in ends]).cast("array<date>"),
        lambda d: (F.col("joining_date") <= d) & (F.col("termination_date").isNull() | (F.col("termination_date") > d)),
    )
    past = wh.view("base_employees_deduplicated").select("nationality", "is_saudi", F.explode(alive).alias("d"))
    earlier = past.groupBy(F.date_format("d", "yyyy-MM").alias("period")).agg(*_population_counts())
    now = wh.view("base_active_workforce").agg(*_population_counts()).select(F.lit(month.label).alias("period"), "*")
    return earlier.unionByName(now).withColumn("saudization_pct", _quota()).orderBy("period")


def _quota_by(wh: Warehouse, key: str) -> DataFrame:
    return (
        wh.view("base_active_workforce")
        .groupBy(key)
        .agg(*_population_counts(), F.count(F.lit(1)).alias("total_headcount"))
        .select(
            F.coalesce(key, F.lit("Unassigned")).alias(key),
            "saudi_headcount", "non_saudi_headcount", "employees_missing_nationality", "total_headcount",
            _quota().alias("saudization_pct"),
        )
    )


@view("mart_saudization_by_project")
def saudization_by_project(wh: Warehouse) -> DataFrame:
    return _quota_by(wh, "project")


@view("mart_saudization_by_department")
def saudization_by_department(wh: Warehouse) -> DataFrame:
    return _quota_by(wh, "department")


@view("mart_document_expiry")
def document_expiry(wh: Warehouse) -> DataFrame:
    """Both document types over the fixed bucket spine; empty buckets are zero.

    One scan: each person gives one row per document type, and the spine is
    added as rows with no count, so no join is needed.
    """
    seen = wh.view("base_document_expiry").select(
        F.inline(
            F.array(
                F.struct(F.col("iqama_bucket").alias("expiry_bucket"), F.lit(1).alias("i"), F.lit(0).alias("w")),
                F.struct(F.col("work_permit_bucket").alias("expiry_bucket"), F.lit(0).alias("i"), F.lit(1).alias("w")),
            )
        )
    )
    spine = wh.spark.createDataFrame([(b, 0, 0) for b in EXPIRY_BUCKETS], "expiry_bucket string, i int, w int")
    return seen.unionByName(spine).groupBy("expiry_bucket").agg(
        F.sum("i").alias("iqama_count"), F.sum("w").alias("work_permit_count")
    )


@view("mart_gosi_status")
def gosi_status(wh: Warehouse) -> DataFrame:
    label = (
        F.when(F.col("gosi_status") == "Registered", "Registered")
        .when(F.col("gosi_status").isNotNull(), "Not Registered")
        .otherwise("Missing Source / Unknown")
    )
    return wh.view("base_compliance_current").groupBy(label.alias("gosi_status")).agg(F.count(F.lit(1)).alias("employee_count"))


@view("mart_wps_status")
def wps_status(wh: Warehouse) -> DataFrame:
    label = F.coalesce("mudad_status", F.lit("Missing Source / Unknown"))
    return wh.view("base_compliance_current").groupBy(label.alias("wps_status")).agg(F.count(F.lit(1)).alias("headcount"))
