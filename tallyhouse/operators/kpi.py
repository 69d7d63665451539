"""KPI rows as long lists with labels, units and threshold statuses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import as_col


@dataclass(frozen=True)
class Status:
    """Status steps tried in order; the first limit that holds decides."""

    steps: tuple[tuple[str, float, str], ...] = ()
    otherwise: str = "neutral"
    judged: str | None = None

    def column(self, value: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(""))
        for comparison, limit, label in self.steps:
            test = {">=": value >= limit, ">": value > limit, "<": value < limit, "abs>": F.abs(value) > limit}[comparison]
            chain = chain.when(test, label)
        return chain.otherwise(self.otherwise)


NEUTRAL = Status()
HEALTHY = Status(otherwise="healthy")


def at_least(limit: float, below: str = "warning", middle: float | None = None, judged: str | None = None) -> Status:
    steps = ((">=", limit, "healthy"),) + (((">=", middle, "warning"),) if middle is not None else ())
    return Status(steps, below, judged)


def above(limit: float, label: str = "warning") -> Status:
    return Status(((">", limit, label),), "healthy")


@dataclass(frozen=True)
class Kpi:
    key: str
    label: str
    unit: str
    status: Status
    column: str | None = None
    scale: float = 1.0


# KPI labels, units and status limits per module (fixed values).
KPIS: dict[str, tuple[Kpi, ...]] = {
    "executive": (
        Kpi("active_headcount", "Active Headcount", "employees", Status(((">", 0.9, "healthy"),), "warning", "data_quality_score")),
        Kpi("joiners_this_month", "Joiners This Month", "employees", NEUTRAL, "joiners_count"),
        Kpi("leavers_this_month", "Leavers This Month", "employees", NEUTRAL, "leavers_count"),
        Kpi("turnover_rate", "Turnover Rate", "%", Status((("<", 0.05, "healthy"),), "warning"), scale=100.0),
        Kpi("payroll_cost", "Payroll Cost", "SAR", NEUTRAL),
        Kpi("overtime_cost", "Overtime Cost", "SAR", above(1000)),
        Kpi("absence_days", "Absence Days", "days", Status((("<", 5, "healthy"),), "warning")),
        Kpi("data_quality_score", "Data Quality Score", "%", at_least(0.90, "critical"), scale=100.0),
    ),
    "workforce": (
        Kpi("active_headcount", "Active Headcount", "employees", HEALTHY),
        Kpi("saudi_headcount", "Saudi Headcount", "employees", HEALTHY),
        Kpi("non_saudi_headcount", "Non-Saudi Headcount", "employees", NEUTRAL),
        Kpi("saudization_rate", "Saudization Rate", "%", at_least(0.40), scale=100.0),
        Kpi("probation_count", "Employees on Probation", "employees", NEUTRAL),
        Kpi("contract_expiring_30", "Contracts Expiring in 30 Days", "contracts", above(0)),
        Kpi("iqama_expiring_30", "Iqamas Expiring in 30 Days", "iqamas", above(0)),
        Kpi("missing_manager_count", "Missing Manager", "issues", above(0)),
        Kpi("missing_project_count", "Missing Project", "issues", above(0)),
        Kpi("missing_cost_center_count", "Missing Cost Center", "issues", above(0)),
    ),
    "payroll": (
        Kpi("total_payroll_cost", "Total Payroll Cost", "SAR", Status((("abs>", 0.10, "warning"),), "neutral", "payroll_variance_pct")),
        Kpi("net_payroll", "Net Payroll", "SAR", HEALTHY),
        Kpi("employees_paid", "Employees Paid", "employees", HEALTHY),
        Kpi("avg_cost_per_employee", "Average Cost per Employee", "SAR", NEUTRAL),
        Kpi("payroll_variance_pct", "Payroll Variance vs Previous Month", "%", Status((("abs>", 0.10, "warning"),), "healthy"), scale=100.0),
        Kpi("basic_salary_cost", "Basic Salary Cost", "SAR", NEUTRAL),
        Kpi("allowances_cost", "Allowances Cost", "SAR", NEUTRAL),
        Kpi("overtime_cost", "Overtime Cost", "SAR", above(10000)),
        Kpi("deductions", "Deductions", "SAR", NEUTRAL),
        Kpi("payroll_exception_count", "Payroll Exception Count", "issues", above(0, "critical")),
    ),
    "attendance": (
        Kpi("attendance_compliance_pct", "Attendance Compliance %", "%", at_least(0.95, "critical", 0.90), scale=100.0),
        Kpi("absence_days", "Absence Days", "days", above(5)),
        Kpi("late_minutes", "Late Minutes", "min", above(120)),
        Kpi("excused_late_minutes", "Excused Late Minutes", "min", NEUTRAL),
        Kpi("net_late_minutes", "Net Late Minutes", "min", above(60)),
        Kpi("early_leave_minutes", "Early Leave Minutes", "min", above(120)),
        Kpi("missing_punch_count", "Missing Punch Count", "punches", above(0, "critical")),
        Kpi("overtime_hours", "Overtime Hours", "hrs", NEUTRAL),
        Kpi("overtime_cost", "Overtime Cost", "SAR", NEUTRAL),
        Kpi("attendance_exception_count", "Attendance Exception Count", "issues", above(0, "critical")),
    ),
    "compliance": (
        Kpi("saudization_pct", "Saudization %", "%", at_least(30, "critical", 15)),
        Kpi("saudi_headcount", "Saudi Headcount", "employees", NEUTRAL),
        Kpi("non_saudi_headcount", "Non-Saudi Headcount", "employees", NEUTRAL),
        Kpi("employees_missing_nationality", "Employees Missing Nationality", "employees", above(0, "critical")),
        Kpi("iqamas_expiring_30", "Iqamas Expiring in 30 Days", "documents", above(0)),
        Kpi("work_permits_expiring_30", "Work Permits Expiring in 30 Days", "documents", above(0)),
        Kpi("iqamas_expired", "Expired Iqamas", "documents", above(0, "critical")),
        Kpi("work_permits_expired", "Expired Work Permits", "documents", above(0, "critical")),
        Kpi("gosi_missing_count", "GOSI Missing / Not Registered Count", "employees", above(0, "critical")),
        Kpi("wps_exception_count", "WPS Exception Count", "employees", above(0, "critical")),
        Kpi("compliance_exception_count", "Compliance Exception Count", "issues", above(0, "critical")),
    ),
    "er": (
        Kpi("total_open_er_cases", "Total Open ER Cases", "cases", above(5, "critical")),
        Kpi("new_cases_this_month", "New Cases This Month", "cases", NEUTRAL),
        Kpi("closed_cases_this_month", "Closed Cases This Month", "cases", NEUTRAL),
        Kpi("average_case_aging_days", "Average Case Aging Days", "days", above(14)),
        Kpi("overdue_cases", "Overdue Cases", "cases", above(0, "critical")),
        Kpi("sla_compliance_pct", "SLA Compliance %", "%", at_least(90, "critical", 75)),
        Kpi("disciplinary_cases", "Disciplinary Cases", "cases", NEUTRAL),
        Kpi("grievance_cases", "Grievance Cases", "cases", NEUTRAL),
        Kpi("labor_cases", "Labor Cases", "cases", NEUTRAL),
        Kpi("escalated_cases", "Escalated Cases", "cases", above(0)),
        Kpi("er_exception_count", "ER Exception Count", "issues", above(0, "critical")),
    ),
    "recruitment": (
        Kpi("open_requisitions", "Open Requisitions", "requisitions", NEUTRAL),
        Kpi("approved_vacancies", "Approved Vacancies", "vacancies", NEUTRAL),
        Kpi("candidates_in_pipeline", "Candidates in Pipeline", "candidates", Status(((">", 0, "healthy"),), "warning")),
        Kpi("interviews_scheduled", "Interviews Scheduled", "interviews", NEUTRAL),
        Kpi("offers_extended", "Offers Extended", "offers", NEUTRAL),
        Kpi("offer_acceptance_pct", "Offer Acceptance %", "%", at_least(80)),
        Kpi("hires_this_month", "Hires This Month", "hires", NEUTRAL),
        Kpi("average_time_to_fill", "Average Time to Fill", "days", above(45)),
        Kpi("overdue_requisitions", "Overdue Requisitions", "requisitions", above(0, "critical")),
        Kpi("workforce_plan_fulfillment_pct", "Workforce Plan Fulfillment %", "%", at_least(90)),
        Kpi("recruitment_exception_count", "Recruitment Exception Count", "alerts", above(0, "critical")),
    ),
    "talent": (
        Kpi("employees_reviewed", "Employees Reviewed", "employees", Status(((">", 0, "healthy"),), "warning")),
        Kpi("review_completion_pct", "Review Completion %", "%", at_least(80)),
        Kpi("average_performance_rating", "Average Performance Rating", "rating", at_least(3.5)),
        Kpi("high_performers", "High Performers", "employees", HEALTHY),
        Kpi("low_performers", "Low / At-Risk Performers", "employees", above(0, "critical")),
        Kpi("goal_completion_pct", "Goal Completion %", "%", at_least(75)),
        Kpi("training_completion_pct", "Training Completion %", "%", at_least(70)),
        Kpi("average_training_hours", "Avg Training Hours / Employee", "hours", NEUTRAL),
        Kpi("critical_roles_covered_pct", "Critical Roles Covered %", "%", at_least(80, "critical")),
        Kpi("ready_successors", "Ready Now Successors", "employees", Status(((">", 0, "healthy"),), "warning")),
        Kpi("talent_exception_count", "Talent Data Exceptions", "alerts", above(0, "critical")),
    ),
}


def kpi_list(row: DataFrame, kpis: tuple[Kpi, ...]) -> DataFrame:
    """One row per KPI from a one-row frame: key, label, value, unit, status."""
    entries = []
    for kpi in kpis:
        raw = F.coalesce(as_col(kpi.column or kpi.key).cast("double"), F.lit(0.0))
        judged = F.coalesce(as_col(kpi.status.judged).cast("double"), F.lit(0.0)) if kpi.status.judged else raw
        entries.append(
            F.struct(
                F.lit(kpi.key).alias("key"),
                F.lit(kpi.label).alias("label"),
                F.round(raw * kpi.scale, 2).alias("value"),
                F.lit(kpi.unit).alias("unit"),
                kpi.status.column(judged).alias("status"),
            )
        )
    return row.select(F.inline(F.array(*entries)))
