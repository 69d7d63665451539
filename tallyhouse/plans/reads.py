"""Serving reads: a view with the order, limit or columns a consumer asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.kpi import KPIS, kpi_list
from tallyhouse.operators.relational import top_k
from tallyhouse.plans.warehouse import Warehouse


# View and sort order per read (fixed values).
READS: dict[str, tuple[str, list]] = {}


def _read(path: str, view: str, *order) -> None:
    READS[path] = (view, list(order))


_read("executive/trends", "mart_exec_trends", ("month", "asc"))
_read("data-quality/summary", "mart_data_quality_summary")
_read("data-quality/exceptions", "mart_data_quality_exceptions")
_read("workforce/trends", "mart_workforce_headcount_trend", ("month", "asc"))
_read("workforce/distribution", "mart_workforce_distribution")
_read("workforce/contract-expiry", "mart_workforce_contract_expiry")
_read("workforce/iqama-expiry", "mart_workforce_iqama_expiry")
_read("workforce/exceptions", "mart_workforce_exceptions")
_read("payroll/reconciliation", "mart_payroll_reconciliation")
_read("payroll/trends", "mart_payroll_trend", ("month", "asc"))
_read("payroll/by-project", "mart_payroll_by_project")
_read("payroll/by-department", "mart_payroll_by_department")
_read("payroll/components", "mart_payroll_components")
_read("payroll/variance-components", "mart_payroll_variance_components")
_read("payroll/exceptions", "mart_payroll_exceptions")
_read("attendance/trends", "mart_attendance_trend", ("month", "asc"))
_read("attendance/by-project", "mart_attendance_by_project")
_read("attendance/by-department", "mart_attendance_by_department")
_read("attendance/late-arrival", "mart_attendance_late_arrival", ("total_late_minutes", "desc"), ("employee_id", "asc"))
_read("attendance/overtime", "mart_attendance_overtime", ("attendance_ot_hours", "desc"), ("employee_id", "asc"))
_read("attendance/missing-punches", "mart_attendance_missing_punches", ("total_missing_punches", "desc"), ("employee_id", "asc"))
_read("attendance/exceptions", "mart_attendance_exceptions")
_read("compliance/saudization", "mart_saudization_summary", ("period", "asc"))
_read("compliance/saudization-by-project", "mart_saudization_by_project", ("project", "asc"))
_read("compliance/saudization-by-department", "mart_saudization_by_department", ("department", "asc"))
_read("compliance/document-expiry", "mart_document_expiry")
_read("compliance/gosi", "mart_gosi_status", ("gosi_status", "asc"))
_read("compliance/wps", "mart_wps_status", ("wps_status", "asc"))
_read("compliance/exceptions", "mart_compliance_exceptions")
_read("er/trends", "mart_er_case_trend", ("period", "asc"))
_read("er/by-project", "mart_er_cases_by_project", ("project", "asc"))
_read("er/by-department", "mart_er_cases_by_department", ("department", "asc"))
_read("er/case-types", "mart_er_case_type_distribution", ("case_type", "asc"))
_read("er/status", "mart_er_case_status_distribution", ("case_status", "asc"))
_read("er/sla", "mart_er_sla_performance", ("category_type", "asc"), ("category", "asc"))
_read("er/aging", "mart_er_aging_buckets")
_read("er/exceptions", "mart_er_exceptions")
_read("recruitment/pipeline", "mart_recruitment_pipeline")
_read("recruitment/trends", "mart_recruitment_trends", ("period", "asc"))
_read("recruitment/by-project", "mart_recruitment_by_project")
_read("recruitment/by-department", "mart_recruitment_by_department")
_read("recruitment/time-to-fill", "mart_recruitment_time_to_fill")
_read("recruitment/source-effectiveness", "mart_recruitment_source_effectiveness")
_read("recruitment/offers", "mart_offer_acceptance")
_read("recruitment/onboarding", "mart_onboarding_status")
_read("recruitment/workforce-plan", "mart_workforce_plan_vs_actual")
_read("recruitment/exceptions", "mart_recruitment_exceptions")
_read("talent/performance-distribution", "mart_performance_distribution", ("performance_category", "asc"))
_read("talent/trends", "mart_talent_review_trends", ("period", "asc"))
_read("talent/by-project", "mart_performance_by_project", ("project", "asc"))
_read("talent/by-department", "mart_performance_by_department", ("department", "asc"))
_read("talent/goals", "mart_goal_completion", ("department", "asc"))
_read("talent/competency-gaps", "mart_competency_gaps", ("avg_gap", "desc"))
_read("talent/learning", "mart_learning_completion", ("category", "asc"))
_read("talent/learning-by-project", "mart_learning_by_project", ("project", "asc"), ("department", "asc"))
_read("talent/succession", "mart_succession_coverage", ("role_title", "asc"))
_read("talent/succession-readiness", "mart_successor_readiness", ("readiness", "asc"))
_read("talent/risk", "mart_talent_risk", ("risk_category", "asc"), ("department", "asc"))
_read("talent/exceptions", "mart_talent_exceptions")
_read("command-center/overview", "mart_command_center_overview")
_read("command-center/module-health", "mart_command_center_module_health")
_read("command-center/priority-alerts", "mart_command_center_priority_alerts")
_read("command-center/exceptions", "mart_command_center_exception_summary")
_read("command-center/data-freshness", "mart_command_center_data_freshness")
_read("command-center/filter-options", "mart_command_center_filter_options")

# KPI view per module (fixed values).
SUMMARIES = {
    "executive": "mart_exec_kpis",
    "workforce": "mart_workforce_kpis",
    "payroll": "mart_payroll_kpis",
    "attendance": "mart_attendance_kpis",
    "compliance": "mart_compliance_kpis",
    "er": "mart_er_kpis",
    "recruitment": "mart_recruitment_kpis",
    "talent": "mart_talent_kpis",
}


def read(wh: Warehouse, path: str) -> DataFrame:
    """Rows behind one read path, in its order; ``<module>/summary`` gives the KPI list."""
    if path == "payroll/variance":
        return payroll_variance(wh)
    module, _, what = path.partition("/")
    if what == "summary" and module in SUMMARIES:
        return kpi_list(wh.view(SUMMARIES[module]), KPIS[module])
    view, order = READS[path]
    keys = [F.desc_nulls_last(c) if way == "desc" else F.asc_nulls_last(c) for c, way in order]
    return wh.view(view).orderBy(*keys) if keys else wh.view(view)


def payroll_variance(wh: Warehouse, k: int = 100) -> DataFrame:
    """The largest pay changes; ties follow employee and amount."""
    rows = wh.view("mart_payroll_variance_employees")
    return top_k(rows, k, F.abs("change_amount").desc(), F.asc_nulls_last("employee_id"), F.asc_nulls_last("curr_amount"))
