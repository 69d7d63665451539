"""Executive, data-quality and workforce views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_empty, ratio, tally, total
from tallyhouse.functions.columns import EXPIRY_BUCKETS, expiry_bucket
from tallyhouse.operators.relational import count_entities, latest_record, side_by_side, stacked_counts, with_repeat_flag
from tallyhouse.operators.rules import flag_rows, stack
from tallyhouse.operators.tables import MonthTable
from tallyhouse.operators.temporal import as_of_count, entity_months
from tallyhouse.plans.texts import WORKFORCE
from tallyhouse.plans.warehouse import Warehouse, rule_from, view
from tallyhouse.session import scratch_dir


@view("base_active_workforce")
def active_workforce(wh: Warehouse) -> DataFrame:
    """One row per active employee: the latest joining, then the latest contract end."""
    return latest_record(
        wh.table("employees").where("status = 'Active'"),
        ["employee_id"],
        [F.desc_nulls_last("joining_date"), F.desc_nulls_last("contract_end_date"), F.asc_nulls_last("employee_name")],
    )


@view("base_employees_deduplicated")
def employees_deduplicated(wh: Warehouse) -> DataFrame:
    """One row per employee, preferring an active record."""
    return latest_record(
        wh.table("employees"),
        ["employee_id"],
        [
            F.desc_nulls_last(F.col("status") == "Active"),
            F.desc_nulls_last("joining_date"),
            F.desc_nulls_last("contract_end_date"),
            F.asc_nulls_last("employee_name"),
        ],
    )


def _headcount_by_month(wh: Warehouse) -> DataFrame:
    """Active headcount of the report month and as-of headcounts of the months before it."""
    month = wh.payroll_month
    earlier = [m.end for m in wh.months_before("payroll", "payroll_period", month)]
    past = as_of_count(wh.table("employees"), "employee_id", "joining_date", "termination_date", earlier, "active_headcount")
    past = past.select(F.date_format("as_of_date", "yyyy-MM").alias("month"), "active_headcount")
    now = wh.view("base_active_workforce").agg(F.count("employee_id").alias("active_headcount"))
    return past.unionByName(now.select(F.lit(month.label).alias("month"), "active_headcount"))


@view("mart_exec_kpis")
def exec_kpis(wh: Warehouse) -> DataFrame:
    month = wh.payroll_month
    start, end = F.lit(month.start), F.lit(month.end)
    people = count_entities(
        wh.table("employees"),
        "employee_id",
        active_headcount=F.col("status") == "Active",
        joiners_count=F.col("joining_date").between(start, end),
        leavers_count=F.col("termination_date").between(start, end),
        all_ids=F.lit(True),
    )
    pay = wh.table("payroll").where(F.col("payroll_period") == month.label).agg(
        total("gross_pay").alias("payroll_cost"), total("overtime_amount").alias("overtime_cost")
    )
    absence = wh.table("attendance").where(F.col("attendance_date").between(start, end)).agg(total("absence_days").alias("absence_days"))
    issues = wh.view("data_quality").agg(F.count(F.lit(1)).alias("issues"))
    row = side_by_side(people, pay, absence, issues)
    checked = F.greatest(F.col("all_ids"), F.lit(1)) * float(wh.rules.quality_checks)
    return row.select(
        F.lit(month.label).alias("report_month"),
        "active_headcount",
        "joiners_count",
        "leavers_count",
        ratio("leavers_count", "active_headcount").alias("turnover_rate"),
        "payroll_cost",
        "overtime_cost",
        "absence_days",
        (1.0 - F.col("issues").cast("double") / checked).alias("data_quality_score"),
    )


@view("mart_exec_trends")
def exec_trends(wh: Warehouse) -> DataFrame:
    cost = wh.table("payroll").groupBy(F.col("payroll_period").alias("month")).agg(total("gross_pay").alias("payroll_cost"))
    return (
        _headcount_by_month(wh)
        .join(cost, "month", "left")
        .select("month", "active_headcount", F.coalesce("payroll_cost", F.lit(0.0)).alias("payroll_cost"))
        .orderBy("month")
    )


@view("mart_data_quality_summary")
def data_quality_summary(wh: Warehouse) -> DataFrame:
    issue = F.col("issue_type")
    counts = wh.view("data_quality").agg(
        tally(issue == "Missing Manager").alias("missing_manager_count"),
        tally(issue == "Missing Project").alias("missing_project_count"),
        tally(issue == "Missing Cost Center").alias("missing_cost_center_count"),
        tally(issue == "Missing Nationality").alias("missing_nationality_count"),
        tally(issue == "Duplicate Employee ID").alias("duplicate_employee_count"),
        tally(
            issue.isin(
                "Inactive Employee with Payroll Record",
                "Negative or Abnormal Payroll Value",
                "Active Employee with Missing Salary",
            )
        ).alias("invalid_payroll_count"),
    )
    score = wh.view("mart_exec_kpis").select("data_quality_score")
    return side_by_side(score, counts)


@view("mart_data_quality_exceptions")
def data_quality_exceptions(wh: Warehouse) -> DataFrame:
    return wh.view("data_quality").select(
        F.col("entity_id").alias("employee_id"),
        F.col("entity_name").alias("employee_name"),
        "issue_type",
        "description",
        "severity",
        "recommended_action",
    )


def _documents(wh: Warehouse) -> DataFrame:
    """Residence permit dates of the compliance period."""
    period = F.col("period") == wh.compliance_month.label
    return wh.table("compliance").where(period).select("employee_id", "iqama_expiry")


@view("mart_workforce_kpis")
def workforce_kpis(wh: Warehouse) -> DataFrame:
    anchor = F.lit(wh.payroll_month.end)

    def soon(column: str):
        return F.datediff(column, anchor).between(0, 30)

    row = count_entities(
        wh.view("base_active_workforce").join(_documents(wh), "employee_id", "left"),
        "employee_id",
        active_headcount=F.lit(True),
        saudi_headcount=F.col("is_saudi"),
        non_saudi_headcount=~F.col("is_saudi"),
        probation_count=F.datediff(anchor, "joining_date").between(0, 90),
        contract_expiring_30=soon("contract_end_date"),
        iqama_expiring_30=soon("iqama_expiry"),
        missing_manager_count=is_empty("manager_id"),
        missing_project_count=is_empty("project"),
        missing_cost_center_count=is_empty("cost_center"),
    )
    return row.select(
        "active_headcount",
        "saudi_headcount",
        "non_saudi_headcount",
        ratio("saudi_headcount", "active_headcount").alias("saudization_rate"),
        "probation_count",
        "contract_expiring_30",
        "iqama_expiring_30",
        "missing_manager_count",
        "missing_project_count",
        "missing_cost_center_count",
    )


@view("mart_workforce_headcount_trend")
def workforce_headcount_trend(wh: Warehouse) -> DataFrame:
    return _headcount_by_month(wh)


@view("mart_workforce_distribution")
def workforce_distribution(wh: Warehouse) -> DataFrame:
    """Headcount by five single dimensions; labels are applied after grouping on the stored value."""
    raw = stacked_counts(
        wh.view("base_active_workforce"),
        {
            "department": F.col("department"),
            "project": F.col("project"),
            "nationality_group": F.col("is_saudi"),
            "employment_type": F.col("employment_type"),
            "status": F.col("status"),
        },
        F.count("employee_id"),
        "headcount",
    )
    group = F.when(F.col("metric_value") == "true", "Saudi").otherwise("Non-Saudi")
    label = F.when(F.col("category") == "nationality_group", group).otherwise(F.coalesce("metric_value", F.lit("Missing")))
    return raw.select("category", label.alias("metric_value"), "headcount")


@view("mart_workforce_contract_expiry")
def workforce_contract_expiry(wh: Warehouse) -> DataFrame:
    bucket = expiry_bucket("contract_end_date", F.lit(wh.payroll_month.end))
    return wh.view("base_active_workforce").select(bucket.alias("bucket")).agg(
        *[tally(F.col("bucket") == b).alias(b) for b in EXPIRY_BUCKETS]
    )


@view("mart_workforce_iqama_expiry")
def workforce_iqama_expiry(wh: Warehouse) -> DataFrame:
    bucket = expiry_bucket("iqama_expiry", F.lit(wh.payroll_month.end))
    people = wh.view("base_active_workforce").where("is_saudi = false").join(_documents(wh), "employee_id", "left")
    return count_entities(
        people.select("employee_id", bucket.alias("bucket")), "employee_id", **{b: F.col("bucket") == b for b in EXPIRY_BUCKETS}
    )


@view("mart_workforce_exceptions")
def workforce_exceptions(wh: Warehouse) -> DataFrame:
    anchor = F.lit(wh.payroll_month.end)

    def rule(issue, when, **slots):
        return rule_from(WORKFORCE, issue, when, **slots)

    active = wh.view("base_active_workforce")
    employees = wh.table("employees")
    current = wh.table("payroll").where(F.col("payroll_period") == wh.payroll_month.label).select("employee_id")
    permits = active.where("is_saudi = false").join(_documents(wh), "employee_id", "left")
    return stack(
        flag_rows(
            active,
            [
                rule("Missing Manager", is_empty("manager_id")),
                rule("Missing Project", is_empty("project")),
                rule("Missing Cost Center", is_empty("cost_center")),
                rule("Contract Expiry Risk", F.datediff("contract_end_date", anchor).between(0, 30)),
                rule("Missing Contract End Date", F.col("contract_end_date").isNull()),
                rule("Missing Department", is_empty("department")),
            ],
            "employee_id",
            "employee_name",
        ),
        flag_rows(
            with_repeat_flag(employees, ["employee_id"], "repeated"),
            [rule("Missing Nationality", is_empty("nationality")), rule("Duplicate Employee ID", F.col("repeated"))],
            "employee_id",
            "employee_name",
        ),
        flag_rows(
            permits,
            [
                rule("Iqama Expiry Risk", F.datediff("iqama_expiry", anchor).between(0, 30)),
                rule("Missing Iqama Expiry Date", F.col("iqama_expiry").isNull()),
            ],
            "employee_id",
            "employee_name",
        ),
        flag_rows(
            current.join(employees.where(F.col("status").isin("Inactive", "Terminated")), "employee_id"),
            [rule("Inactive Employee Payroll", F.lit(True))],
            "employee_id",
            "employee_name",
        ),
    )


# Fields of the monthly snapshot behind month, employee and status (fixed values).
SNAPSHOT_FIELDS = (
    "company", "department", "project", "job_title", "job_family", "grade", "manager_id", "cost_center", "nationality", "is_saudi", "basic_salary",
    "contract_type", "contract_end_date",
)


def headcount_months(wh: Warehouse) -> DataFrame:
    """Every employee in every month from joining to leaving, up to the report month, with the status of that month."""
    month = wh.payroll_month
    people = wh.view("base_employees_deduplicated").where("joining_date IS NOT NULL")
    left = F.col("termination_date")
    months = entity_months(people, "employee_id", F.col("joining_date"), left, last=month.end)
    status = F.when(left <= F.last_day("month_start"), "Terminated").when(F.col("status") == "Terminated", "Active").otherwise(F.col("status"))
    return months.select(F.date_format("month_start", "yyyy-MM").alias("snapshot_month"), "employee_id", status.alias("status"), *SNAPSHOT_FIELDS)


@view("fact_headcount_snapshot")
def headcount_snapshot(wh: Warehouse) -> DataFrame:
    """The monthly snapshot as a stored table, partitioned by month."""
    table = MonthTable(wh.spark, scratch_dir(wh.spark, "headcount"), "snapshot_month", "employee_id")
    table.write(headcount_months(wh))
    return table.read().select("snapshot_month", "employee_id", "status", *SNAPSHOT_FIELDS)
