"""Reconciliation checks of a finished build.

Each check compares a published number with an independent recomputation. A
domain's numbers are put in one row, so its checks cost one pass; only failed
checks ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_filled, percent, tally, total, whole
from tallyhouse.operators.reconcile import all_checks, checks_of, require
from tallyhouse.operators.relational import drop_members, side_by_side
from tallyhouse.operators.temporal import expand_days
from tallyhouse.plans.params import HIGH_RATINGS, LOW_RATINGS, OPEN_CASE, OPEN_REQUISITION
from tallyhouse.plans.warehouse import Warehouse

MONEY, SHARE, TALENT_SHARE, OVERVIEW_SHARE = 0.01, 0.01, 0.1, 0.001


def _row(wh: Warehouse, view: str, **measures: Column) -> DataFrame:
    return wh.view(view).agg(*[m.alias(n) for n, m in measures.items()])


def _rows(wh: Warehouse, view: str, name: str, where: Column | None = None) -> DataFrame:
    frame = wh.view(view) if where is None else wh.view(view).where(where)
    return frame.agg(F.count(F.lit(1)).alias(name))


def workforce(wh: Warehouse) -> DataFrame:
    hc = wh.view("mart_workforce_kpis").select("active_headcount")
    categories = wh.view("mart_workforce_distribution").groupBy("category").agg(F.sum("headcount").alias("n"))
    per_category = categories.withColumn("active_headcount", hc.scalar())
    named = per_category.select(F.concat(F.lit("Distribution total: "), "category").alias("check_name"), "active_headcount", "n")
    distribution = named.select(
        "check_name",
        F.col("active_headcount").cast("double").alias("expected"),
        F.col("n").cast("double").alias("actual"),
        F.abs(F.col("active_headcount") - F.col("n")).cast("double").alias("difference"),
        F.lit(0.0).alias("tolerance"),
        (F.col("active_headcount") == F.col("n")).alias("passed"),
    )
    buckets = wh.view("mart_workforce_contract_expiry")
    all_buckets = sum((F.col(f"`{c}`") for c in buckets.columns[1:]), F.col(f"`{buckets.columns[0]}`"))
    row = side_by_side(hc, buckets.select(all_buckets.alias("in_buckets")))
    return all_checks(distribution, checks_of(row, [("Contract expiry bucket total", "active_headcount", "in_buckets", 0.0)]))


def payroll(wh: Warehouse) -> DataFrame:
    current = wh.view("base_payroll_current")
    issues = wh.view("mart_payroll_exceptions")
    parts = F.col("basic_salary") + F.col("housing_allowance") + F.col("transport_allowance") + F.col("other_allowances") + F.col("overtime_amount")

    def without(issue: str) -> DataFrame:
        return drop_members(current, "employee_id", issues.where(F.col("issue_type") == issue).select("entity_id"))

    row = side_by_side(
        wh.view("mart_payroll_kpis").select("total_payroll_cost", "employees_paid", "payroll_exception_count"),
        current.agg(total("gross_pay").alias("gross"), F.count_distinct("employee_id").alias("paid")),
        without("Payroll Component Mismatch").agg(total(F.col("gross_pay") - parts).alias("gross_gap")),
        without("Net Pay Mismatch").agg(total(F.col("net_pay") - (F.col("gross_pay") - F.col("deductions"))).alias("net_gap")),
        _row(wh, "mart_payroll_by_project", projects=total("total_payroll_cost")),
        _row(wh, "mart_payroll_by_department", departments=total("total_payroll_cost")),
        _rows(wh, "mart_payroll_exceptions", "issues"),
    )
    return checks_of(
        row,
        [
            ("Gross pay equals payroll cost", "total_payroll_cost", "gross", MONEY),
            ("Components equal gross pay outside exceptions", F.lit(0.0), "gross_gap", MONEY),
            ("Net equals gross minus deductions outside exceptions", F.lit(0.0), "net_gap", MONEY),
            ("Project payroll total", "total_payroll_cost", "projects", MONEY),
            ("Department payroll total", "total_payroll_cost", "departments", MONEY),
            ("Employees paid", "employees_paid", "paid", 0.0),
            ("Payroll exception count", "payroll_exception_count", "issues", 0.0),
        ],
    )


def attendance(wh: Warehouse) -> DataFrame:
    month = wh.attendance_month
    people = wh.view("base_employees_deduplicated").where("status = 'Active' and joining_date is not null")
    calendar = expand_days(
        people, F.greatest(F.lit(month.start), F.col("joining_date")), F.least(F.lit(month.end), F.col("termination_date")), "day", wh.rules.weekend_days
    )
    net = F.greatest(F.col("calculated_late_minutes") - F.coalesce("excused_late_minutes", F.lit(0)), F.lit(0))
    row = side_by_side(
        wh.view("mart_attendance_kpis").select(
            "absence_days", "late_minutes", "missing_punch_count", "overtime_hours", "overtime_cost", "attendance_exception_count"
        ),
        _row(
            wh, "base_expected_attendance", workdays=F.count(F.lit(1)),
            absent=tally(F.col("attendance_date").isNull() | (F.col("absence_days") == 1.0)),
        ),
        calendar.agg(F.count(F.lit(1)).alias("calendar_days")),
        _row(wh, "base_attendance_current", late=whole("calculated_late_minutes"), net_mismatch=tally(F.col("calculated_net_late_minutes") != net)),
        _rows(wh, "mart_attendance_exceptions", "punch_issues", F.col("issue_type").isin("Missing Check-in", "Missing Check-out")),
        _row(wh, "base_attendance_payroll_overtime", hours=total("attendance_ot_hours"), cost=total("payroll_ot_cost")),
        _rows(wh, "mart_attendance_exceptions", "issues"),
    )
    return checks_of(
        row,
        [
            ("Expected workdays", "calendar_days", "workdays", 0.0),
            ("Absence days", "absence_days", "absent", 0.01),
            ("Late minutes", "late_minutes", "late", 0.01),
            ("Net late minutes", F.lit(0), "net_mismatch", 0.0),
            ("Missing punches", "missing_punch_count", "punch_issues", 0.0),
            ("Approved overtime hours", "overtime_hours", "hours", 0.01),
            ("Payroll overtime cost", "overtime_cost", "cost", MONEY),
            ("Attendance exception count", "attendance_exception_count", "issues", 0.0),
        ],
    )


def compliance(wh: Warehouse) -> DataFrame:
    people = F.col("saudi_headcount") + F.col("non_saudi_headcount") + F.col("employees_missing_nationality")
    row = side_by_side(
        wh.view("mart_compliance_kpis"),
        wh.view("mart_workforce_kpis").select("active_headcount"),
        _row(wh, "mart_saudization_by_project", projects=F.sum(people)),
        _row(wh, "mart_saudization_by_department", departments=F.sum(people)),
        _row(wh, "mart_document_expiry", iqamas=F.sum("iqama_count"), permits=F.sum("work_permit_count")),
        _row(wh, "mart_gosi_status", gosi=F.sum("employee_count")),
        _row(wh, "mart_wps_status", wps=F.sum("headcount")),
        _rows(wh, "mart_compliance_exceptions", "issues"),
    )
    quota = percent("saudi_headcount", F.col("saudi_headcount") + F.col("non_saudi_headcount"))
    return checks_of(
        row,
        [
            ("Nationality groups cover active headcount", "active_headcount", people, 0.0),
            ("Saudization %", "saudization_pct", quota, SHARE),
            ("Project headcount total", "active_headcount", "projects", 0.0),
            ("Department headcount total", "active_headcount", "departments", 0.0),
            ("Iqama bucket total", "non_saudi_headcount", "iqamas", 0.0),
            ("Work permit bucket total", "non_saudi_headcount", "permits", 0.0),
            ("GOSI status total", "active_headcount", "gosi", 0.0),
            ("WPS status total", "active_headcount", "wps", 0.0),
            ("Compliance exception count", "compliance_exception_count", "issues", 0.0),
        ],
    )


def cases(wh: Warehouse) -> DataFrame:
    from tallyhouse.plans.cases import _cases

    start, end = F.lit(wh.case_month.start), F.lit(wh.case_month.end)
    opened, status = F.col("case_status").isin(*OPEN_CASE), F.col("sla_status")
    row = side_by_side(
        wh.view("mart_er_kpis"),
        _cases(wh).agg(
            F.count(F.lit(1)).alias("cases"),
            tally(opened).alias("open_now"),
            tally((F.col("closed_date") >= start) & (F.col("closed_date") <= end)).alias("closed_now"),
            tally((F.col("created_date") >= start) & (F.col("created_date") <= end)).alias("new_now"),
            tally(status == "Compliant").alias("compliant"),
            tally((status == "Compliant") | (status == "Breached")).alias("judged"),
            tally(opened & (F.col("effective_target_due_date") < end)).alias("late_now"),
        ),
        _row(wh, "mart_er_case_type_distribution", types=F.sum("case_count")),
        _row(wh, "mart_er_case_status_distribution", statuses=F.sum("case_count")),
        _row(wh, "mart_er_cases_by_project", projects=F.sum("total_cases")),
        _row(wh, "mart_er_cases_by_department", departments=F.sum("total_cases")),
        _rows(wh, "mart_er_exceptions", "issues"),
        _row(wh, "mart_er_aging_buckets", aged=F.sum("case_count")),
    )
    return checks_of(
        row,
        [
            ("Total open cases", "total_open_er_cases", "open_now", 0.0),
            ("Closed cases this month", "closed_cases_this_month", "closed_now", 0.0),
            ("New cases this month", "new_cases_this_month", "new_now", 0.0),
            ("Case type total", "cases", "types", 0.0),
            ("Case status total", "cases", "statuses", 0.0),
            ("Project case total", "cases", "projects", 0.0),
            ("Department case total", "cases", "departments", 0.0),
            ("SLA compliance %", "sla_compliance_pct", percent("compliant", "judged", 100.0), SHARE),
            ("Overdue cases", "overdue_cases", "late_now", 0.0),
            ("Case exception count", "er_exception_count", "issues", 0.0),
            ("Aging bucket total", "total_open_er_cases", "aged", 0.0),
        ],
    )


def recruitment(wh: Warehouse) -> DataFrame:
    from tallyhouse.plans.recruitment import _hires

    end = F.lit(wh.hiring_month.end)
    opened, status = F.col("status").isin(*OPEN_REQUISITION), F.col("offer_status")
    plan, people = wh.view("base_workforce_plan_current"), wh.view("base_active_workforce")
    matched = people.select("project", "department").join(plan.select("project", "department"), ["project", "department"])
    row = side_by_side(
        wh.view("mart_recruitment_kpis"),
        _row(
            wh, "base_recruitment_requisitions_current", reqs=F.count(F.lit(1)), open_now=tally(opened),
            late_now=tally(opened & (F.col("effective_target_hire_date") < end)),
        ),
        _row(wh, "base_vacancy_population", vacancies=whole("quantity")),
        _rows(wh, "base_candidate_pipeline_current", "pipeline"),
        _rows(wh, "base_interview_activity_current", "interviews"),
        _row(
            wh, "base_offer_activity_current", offers=F.count(F.lit(1)), accepted=tally(status == "Accepted"),
            decided=tally(status.isin("Accepted", "Rejected", "Declined")),
        ),
        _rows(wh, "base_onboarding_current", "hires"),
        _hires(wh).agg(F.coalesce(F.round(F.sum("days_to_fill") / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0)).alias("fill")),
        plan.agg(whole("planned_headcount").alias("planned")),
        matched.agg(F.count(F.lit(1)).alias("matched")),
        _row(wh, "mart_recruitment_by_project", projects=F.sum("total_requisitions")),
        _row(wh, "mart_recruitment_by_department", departments=F.sum("total_requisitions")),
        _rows(wh, "mart_recruitment_exceptions", "issues"),
    )
    fulfilled = F.when(F.col("planned") == 0, F.when(F.col("matched") == 0, 100.0).otherwise(0.0)).otherwise(percent("matched", "planned"))
    return checks_of(
        row,
        [
            ("Open requisitions", "open_requisitions", "open_now", 0.0),
            ("Approved vacancies", "approved_vacancies", "vacancies", 0.0),
            ("Candidates in pipeline", "candidates_in_pipeline", "pipeline", 0.0),
            ("Interviews scheduled", "interviews_scheduled", "interviews", 0.0),
            ("Offers extended", "offers_extended", "offers", 0.0),
            ("Offer acceptance %", "offer_acceptance_pct", percent("accepted", "decided", 100.0), SHARE),
            ("Hires this month", "hires_this_month", "hires", 0.0),
            ("Average time to fill", "average_time_to_fill", "fill", 0.01),
            ("Overdue requisitions", "overdue_requisitions", "late_now", 0.0),
            ("Workforce plan fulfillment %", "workforce_plan_fulfillment_pct", fulfilled, SHARE),
            ("Project requisition total", "reqs", "projects", 0.0),
            ("Department requisition total", "reqs", "departments", 0.0),
            ("Recruitment exception count", "recruitment_exception_count", "issues", 0.0),
        ],
    )


def talent(wh: Warehouse) -> DataFrame:
    from tallyhouse.plans.talent import _learning, _plans_with_flag

    category, done, kept = F.col("performance_category"), F.col("status") == "Completed", F.col("status") != "Cancelled"
    plans = _plans_with_flag(wh)
    valid = plans.where(is_filled("successor_employee_id") & F.col("known") & is_filled("readiness"))
    learning = _learning(wh)
    row = side_by_side(
        wh.view("mart_talent_kpis"),
        _row(
            wh, "base_performance_reviews_current", reviewed=F.count_distinct("employee_id"),
            mean=F.round(F.sum("rating") / F.nullif(F.count("rating"), F.lit(0)), 2),
            high=F.count_distinct(F.when(category.isin(*HIGH_RATINGS), F.col("employee_id"))),
            low=F.count_distinct(F.when(category.isin(*LOW_RATINGS), F.col("employee_id"))),
        ),
        _rows(wh, "base_talent_employee_population", "people"),
        _row(wh, "mart_performance_distribution", spread=F.sum("employee_count")),
        _row(wh, "base_performance_goals_current", goals_done=tally(done), goals=tally(kept)),
        _row(wh, "base_learning_enrollments_current", courses_done=tally(done), courses=tally(kept)),
        learning.where(done).agg(total("duration_hours").alias("hours"), F.count_distinct("employee_id").alias("trainees")),
        plans.agg(F.count_distinct("critical_role_id").alias("roles")),
        valid.agg(F.count_distinct("critical_role_id").alias("covered")),
        plans.where((F.col("readiness") == "Ready Now") & F.col("known")).agg(F.count_distinct("successor_employee_id").alias("ready")),
        _row(wh, "mart_performance_by_project", by_project=F.sum("reviewed_count")),
        _rows(wh, "mart_talent_exceptions", "issues"),
    )
    hours = F.when(F.col("trainees") == 0, 0.0).otherwise(F.round(F.col("hours") / F.nullif("trainees", F.lit(0)), 2))
    return checks_of(
        row,
        [
            ("Employees reviewed", "employees_reviewed", "reviewed", 0.0),
            ("Review completion %", "review_completion_pct", percent("reviewed", "people"), TALENT_SHARE),
            ("Average performance rating", "average_performance_rating", "mean", 0.01),
            ("Performance distribution total", "reviewed", "spread", 0.0),
            ("High performers", "high_performers", "high", 0.0),
            ("Low performers", "low_performers", "low", 0.0),
            ("Goal completion %", "goal_completion_pct", percent("goals_done", "goals"), TALENT_SHARE),
            ("Training completion %", "training_completion_pct", percent("courses_done", "courses"), TALENT_SHARE),
            ("Average training hours", "average_training_hours", hours, TALENT_SHARE),
            ("Critical roles covered %", "critical_roles_covered_pct", percent("covered", "roles", 100.0), TALENT_SHARE),
            ("Ready successors", "ready_successors", "ready", 0.0),
            ("Reviewed by project total", "reviewed", "by_project", 0.0),
            ("Talent exception count", "talent_exception_count", "issues", 0.0),
        ],
    )


def command_center(wh: Warehouse) -> DataFrame:
    from tallyhouse.plans.command_center import number_listed

    row = side_by_side(
        wh.view("command_center_overview_data").drop("last_data_refresh"),
        wh.view("mart_workforce_kpis").select(F.col("active_headcount").alias("hc")),
        wh.view("mart_payroll_kpis").select(F.col("total_payroll_cost").alias("pay")),
        wh.view("mart_attendance_kpis").select(F.col("attendance_compliance_pct").alias("att")),
        wh.view("mart_compliance_kpis").select(F.col("saudization_pct").alias("quota")),
        wh.view("mart_er_kpis").select(F.col("total_open_er_cases").alias("er")),
        wh.view("mart_recruitment_kpis").select(F.col("open_requisitions").alias("req")),
        wh.view("mart_talent_kpis").select(F.col("review_completion_pct").alias("rev")),
        number_listed(wh, "issues"),
        _rows(wh, "base_command_center_module_registry", "modules"),
        _rows(wh, "mart_command_center_data_freshness", "fresh"),
    )
    return checks_of(
        row,
        [
            ("Overview active headcount", "hc", "active_headcount", 0.0),
            ("Overview payroll cost", "pay", "payroll_cost", MONEY),
            ("Overview attendance compliance", "att", "attendance_compliance_pct", OVERVIEW_SHARE),
            ("Overview saudization %", "quota", "saudization_pct", OVERVIEW_SHARE),
            ("Overview open cases", "er", "open_er_cases", 0.0),
            ("Overview open requisitions", "req", "open_requisitions", 0.0),
            ("Overview review completion %", "rev", "review_completion_pct", OVERVIEW_SHARE),
            ("Overview total exceptions", "issues", "total_active_exceptions", 0.0),
            ("Module registry count", F.lit(9), "modules", 0.0),
            ("Data freshness rows", F.lit(9), "fresh", 0.0),
        ],
    )


CHECKS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "workforce": workforce,
    "payroll": payroll,
    "attendance": attendance,
    "compliance": compliance,
    "cases": cases,
    "recruitment": recruitment,
    "talent": talent,
    "command_center": command_center,
}


def run_checks(wh: Warehouse, domains: tuple[str, ...] = tuple(CHECKS)) -> DataFrame:
    return all_checks(*[CHECKS[d](wh) for d in domains])


def assert_reconciled(wh: Warehouse, domains: tuple[str, ...] = tuple(CHECKS)) -> None:
    """Raise if any check of the chosen domains fails."""
    require(run_checks(wh, domains))
