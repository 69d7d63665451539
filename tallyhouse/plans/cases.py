"""Employee case and service request views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_blank, percent, tally
from tallyhouse.operators.identity import surrogate_id
from tallyhouse.operators.relational import side_by_side, with_repeat_flag
from tallyhouse.operators.rules import Mark, flag_marked
from tallyhouse.operators.temporal import aging_band, aging_days, sla_status
from tallyhouse.plans.compliance import employee_class
from tallyhouse.plans.params import OPEN_CASE
from tallyhouse.plans.texts import CASES
from tallyhouse.plans.warehouse import Warehouse, rule_from, view

# Sort keys of the case row number; the case number settles ties.
CASE_ORDER = ("case_id", "employee_id", "created_date", "case_type", "priority", "case_number")


def _relevant(wh: Warehouse) -> DataFrame:
    """Cases open in, or touched in, the report month, in the columns of their source."""
    start, end = F.lit(wh.case_month.start), F.lit(wh.case_month.end)
    cases = wh.table("employee_relations")
    closed = F.col("closed_date")
    relevant = (F.col("created_date") <= end) & (
        closed.isNull() | (closed >= start) | F.col("created_date").between(start, end)
    )
    return cases.where(relevant)


def _with_subject(wh: Warehouse, rows: DataFrame) -> DataFrame:
    """The attributes of the employee in ``employee_id``; one row each."""
    people = wh.view("base_employees_deduplicated").select(
        F.col("employee_id").alias("_id"), "employee_name",
        F.coalesce("project", F.lit("Unassigned")).alias("_project"),
        F.coalesce("department", F.lit("Unassigned")).alias("_department"),
        "manager_id", "company", "nationality", "job_title", "cost_center", F.col("status").alias("_status"),
    )
    return rows.join(people, F.col("employee_id") == F.col("_id"), "left").select(
        *rows.columns, "employee_name",
        F.coalesce("_project", F.lit("Unassigned")).alias("project"),
        F.coalesce("_department", F.lit("Unassigned")).alias("department"),
        "manager_id", "company", "nationality", "job_title", "cost_center",
        employee_class(F.col("_id"), F.col("_status")).alias("subject_classification"),
    )


def _with_clock(wh: Warehouse, cases: DataFrame) -> DataFrame:
    """The SLA clock needs only columns of the case, so it is computed on the row instead of through a join on a row number."""
    end, closed = F.lit(wh.case_month.end), F.col("closed_date")
    days = F.lit(wh.rules.default_sla_days)
    for kind, limit in wh.rules.case_sla_days.items():
        days = F.when(F.col("case_type") == kind, F.lit(limit)).otherwise(days)
    due = F.coalesce("target_due_date", F.date_add("created_date", days))
    clocked = cases.select(*cases.columns, aging_days(F.col("created_date"), closed, end).alias("aging_days"), due.alias("effective_target_due_date"))
    return clocked.withColumn("sla_status", sla_status(F.col("created_date"), closed, F.col("effective_target_due_date"), end))


def _cases(wh: Warehouse) -> DataFrame:
    """Cases of the report month with the subject's attributes and SLA clock."""
    return _with_clock(wh, _with_subject(wh, _relevant(wh)))


CLOCK = ("aging_days", "sla_status", "effective_target_due_date")


def _with_owner(wh: Warehouse, cases: DataFrame) -> DataFrame:
    people = wh.view("base_employees_deduplicated").select(
        F.col("employee_id").alias("_owner"), F.col("employee_name").alias("owner_employee_name"), F.col("status").alias("owner_raw_status")
    )
    kind = F.when(is_blank("owner_id"), "Unknown Employee").otherwise(employee_class(F.col("_owner"), F.col("owner_raw_status")))
    return (
        cases.join(people, F.col("owner_id") == F.col("_owner"), "left").withColumn("owner_classification", kind).drop("_owner")
    )


def _numbered(wh: Warehouse) -> DataFrame:
    if "_numbered_cases" not in wh._views:
        # Numbered in the columns of their source: what is looked up or computed is not sorted and stored with them.
        numbered = surrogate_id(_relevant(wh), CASE_ORDER, "er_case_record_id")
        wh._views["_numbered_cases"] = _with_clock(wh, _with_subject(wh, numbered))
    return wh._views["_numbered_cases"]


@view("base_er_cases_current")
def er_cases_current(wh: Warehouse) -> DataFrame:
    return _numbered(wh).drop(*CLOCK)


@view("base_er_case_parties")
def er_case_parties(wh: Warehouse) -> DataFrame:
    return _with_owner(wh, _numbered(wh)).select(
        "er_case_record_id", "case_id",
        F.col("employee_id").alias("subject_employee_id"), F.col("employee_name").alias("subject_employee_name"), "subject_classification",
        F.col("owner_id").alias("owner_employee_id"), "owner_employee_name", "owner_raw_status", "owner_classification",
    )


@view("base_hr_requests_current")
def hr_requests_current(wh: Warehouse) -> DataFrame:
    start, end = F.lit(wh.case_month.start), F.lit(wh.case_month.end)
    requests = wh.table("hr_requests")
    people = wh.view("base_employees_deduplicated").select(
        F.col("employee_id").alias("_id"), F.col("project").alias("_project"), F.col("department").alias("_department")
    )
    active = (F.to_date("created_at") <= end) & (F.col("closed_at").isNull() | (F.to_date("closed_at") >= start))
    return requests.where(active).join(people, F.col("employee_id") == F.col("_id"), "left").select(
        "request_id", "employee_id", "request_type", "request_status", "created_at", "closed_at", F.col("owner").alias("owner_id"),
        "sla_hours", "actual_hours", "sla_breached",
        F.coalesce("project", "_project", F.lit("Unassigned")).alias("project"),
        F.coalesce("_department", F.lit("Unassigned")).alias("department"),
    )


def _request_status() -> Column:
    return (
        F.when(F.col("sla_hours").isNull(), "Not Eligible")
        .when(F.col("actual_hours") <= F.col("sla_hours"), "Compliant")
        .otherwise("Breached")
    )


@view("base_case_sla_clock")
def case_sla_clock(wh: Warehouse) -> DataFrame:
    """Clocks of cases and requests under one text key."""
    end = F.lit(wh.case_month.end)
    cases = _numbered(wh).select(
        F.lit("ER").alias("source_type"), F.col("er_case_record_id").cast("string").alias("record_id"),
        F.col("effective_target_due_date").alias("effective_due_date"), "aging_days", "sla_status",
    )
    requests = wh.view("base_hr_requests_current").select(
        F.lit("HR_REQ").alias("source_type"), F.col("request_id").alias("record_id"), F.lit(None).cast("date").alias("effective_due_date"),
        aging_days(F.to_date("created_at"), F.to_date("closed_at"), end).alias("aging_days"), _request_status().alias("sla_status"),
    )
    return cases.unionByName(requests)


@view("base_er_case_population")
def er_case_population(wh: Warehouse) -> DataFrame:
    return _numbered(wh)


def _open() -> Column:
    return F.col("case_status").isin(*OPEN_CASE)


@view("mart_er_exceptions")
def er_exceptions(wh: Warehouse) -> DataFrame:
    end = F.lit(wh.case_month.end)

    def rule(issue, when, **slots):
        return rule_from(CASES, issue, when, **slots)

    owner, subject = F.col("owner_classification"), F.col("subject_classification")
    return flag_marked(
        _with_clock(wh, _relevant(wh)),
        [
            # Repeats are sought among the cases as they are, before people are joined to them.
            Mark(
                ["case_id"],
                lambda rows, weight: with_repeat_flag(rows, ["case_id"], "repeated", weight),
                [rule("Duplicate Case ID", F.col("repeated"))],
            ),
            Mark(
                ["employee_id", "case_status"],
                lambda rows, _: _with_subject(wh, rows),
                [
                    rule("Missing Project", _open() & (F.col("project") == "Unassigned")),
                    rule("Missing Department", _open() & (F.col("department") == "Unassigned")),
                    rule("Inactive Case Subject", subject.isin("Inactive Employee", "Terminated Employee")),
                ],
            ),
            Mark(
                ["owner_id"],
                lambda rows, _: _with_owner(wh, rows),
                [
                    rule(
                        "Inactive Case Owner",
                        owner.isin("Inactive Employee", "Terminated Employee", "Unknown Employee"),
                        entity_name="owner_employee_name",
                    )
                ],
            ),
        ],
        [
            rule("Missing Case Owner", _open() & is_blank("owner_id")),
            rule("Missing Case Type", _open() & is_blank("case_type")),
            rule("Missing Priority", _open() & is_blank("priority")),
            rule("Missing Target Due Date", _open() & F.col("target_due_date").isNull()),
            rule("Overdue Open Case", _open() & (end > F.col("effective_target_due_date")), due="effective_target_due_date"),
            rule("Missing Closure Date", (F.col("case_status") == "Closed") & F.col("closed_date").isNull()),
            rule("Invalid Date Range", F.col("closed_date") < F.col("created_date")),
            rule("Missing SLA Status", F.col("sla_status") == "Not Eligible"),
            rule("Missing Escalation Reason", F.col("escalated") & is_blank("escalation_reason")),
            rule("Missing Legal Reference", (F.col("case_type") == "Labor Case") & (is_blank("legal_reference") | is_blank("case_number"))),
        ],
        "case_id",
        "employee_name",
    )


def _judged() -> Column:
    return tally(F.col("sla_status").isin("Compliant", "Breached"))


def _compliant() -> Column:
    return tally(F.col("sla_status") == "Compliant")


@view("mart_er_kpis")
def er_kpis(wh: Warehouse) -> DataFrame:
    start, end = F.lit(wh.case_month.start), F.lit(wh.case_month.end)
    kind = F.col("case_type")
    cases = _cases(wh).agg(
        tally(_open()).alias("total_open_er_cases"),
        tally(F.col("created_date").between(start, end)).alias("new_cases_this_month"),
        tally(F.col("closed_date").between(start, end)).alias("closed_cases_this_month"),
        F.coalesce(F.round(F.avg("aging_days"), 1), F.lit(0.0)).alias("average_case_aging_days"),
        tally(_open() & (end > F.col("effective_target_due_date"))).alias("overdue_cases"),
        percent(_compliant(), _judged(), 100.0).alias("sla_compliance_pct"),
        tally(kind == "Disciplinary").alias("disciplinary_cases"),
        tally(kind == "Grievance").alias("grievance_cases"),
        tally(kind == "Labor Case").alias("labor_cases"),
        tally(F.col("escalated")).alias("escalated_cases"),
    )
    return side_by_side(cases, wh.number_of_issues("mart_er_exceptions", "er_exception_count"))


@view("mart_er_case_trend")
def er_case_trend(wh: Warehouse) -> DataFrame:
    """New and closed cases of every month up to the report month, from one scan."""
    end = F.lit(wh.case_month.end)
    created, closed = F.col("created_date"), F.col("closed_date")
    events = wh.table("employee_relations").where(created <= end).select(
        F.inline(
            F.array(
                F.struct(F.trunc(created, "month").alias("m"), F.lit(1).alias("new"), F.lit(0).alias("closed")),
                # A case closed before the month it was opened in belongs to no month's population.
                F.struct(
                    F.when(created <= F.last_day(closed), F.trunc(closed, "month")).alias("m"), F.lit(0).alias("new"), F.lit(1).alias("closed")
                ),
            )
        )
    )
    return (
        events.where(F.col("m") <= end)
        .groupBy(F.date_format("m", "yyyy-MM").alias("period"))
        .agg(F.sum("new").alias("new_cases"), F.sum("closed").alias("closed_cases"))
        .orderBy("period")
    )


def _cases_by(wh: Warehouse, key: str) -> DataFrame:
    return _cases(wh).groupBy(key).agg(
        F.count(F.lit(1)).alias("total_cases"),
        tally(_open()).alias("open_cases"),
        tally(F.col("case_status") == "Closed").alias("closed_cases"),
        tally(F.col("escalated")).alias("escalated_cases"),
        _compliant().alias("compliant_cases"),
        percent(_compliant(), _judged(), 100.0).alias("compliance_pct"),
    )


@view("mart_er_cases_by_project")
def er_cases_by_project(wh: Warehouse) -> DataFrame:
    return _cases_by(wh, "project")


@view("mart_er_cases_by_department")
def er_cases_by_department(wh: Warehouse) -> DataFrame:
    return _cases_by(wh, "department")


@view("mart_er_case_type_distribution")
def er_case_type_distribution(wh: Warehouse) -> DataFrame:
    return _cases(wh).groupBy("case_type").agg(F.count(F.lit(1)).alias("case_count"))


@view("mart_er_case_status_distribution")
def er_case_status_distribution(wh: Warehouse) -> DataFrame:
    return _cases(wh).groupBy("case_status").agg(F.count(F.lit(1)).alias("case_count"))


@view("mart_er_sla_performance")
def er_sla_performance(wh: Warehouse) -> DataFrame:
    cases = _cases(wh).select(F.lit("ER").alias("category_type"), F.col("case_type").alias("category"), "sla_status")
    requests = wh.view("base_hr_requests_current").select(
        F.lit("HR_REQ").alias("category_type"), F.col("request_type").alias("category"), _request_status().alias("sla_status")
    )
    return cases.unionByName(requests).groupBy("category_type", "category").agg(
        _judged().alias("eligible_count"),
        _compliant().alias("compliant_count"),
        tally(F.col("sla_status") == "Breached").alias("breached_count"),
        percent(_compliant(), _judged(), 100.0).alias("compliance_pct"),
    )


@view("mart_er_aging_buckets")
def er_aging_buckets(wh: Warehouse) -> DataFrame:
    band = aging_band(F.col("aging_days"))
    return _cases(wh).where(_open()).groupBy(band.alias("aging_bucket")).agg(F.count(F.lit(1)).alias("case_count"))
