"""Every exception rule fires on the fixture, and KPI values equal hand-computed ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import texts
from tallyhouse.plans.checks import CHECKS, assert_reconciled
from tallyhouse.operators.reconcile import ReconciliationError

# A case without creation date is never in the month's population, so its clock always has a status.
NEVER = {"Missing SLA Status"}

MODULES = {
    "mart_workforce_exceptions": texts.WORKFORCE,
    "mart_payroll_exceptions": texts.PAYROLL,
    "mart_attendance_exceptions": texts.ATTENDANCE,
    "mart_compliance_exceptions": texts.COMPLIANCE,
    "mart_er_exceptions": texts.CASES,
    "mart_recruitment_exceptions": texts.RECRUITMENT,
    "mart_talent_exceptions": texts.TALENT,
    "data_quality": texts.VALIDATION,
}


@pytest.mark.parametrize("view", MODULES)
def test_every_rule_fires(people, view):
    found = {r.issue_type for r in people.view(view).select("issue_type").distinct().collect()}
    assert found == set(MODULES[view]) - NEVER


@pytest.mark.parametrize("view", MODULES)
def test_wording_is_complete(people, view):
    rows = people.view(view).collect()
    for row in rows:
        text = MODULES[view][row.issue_type]
        assert row.severity == text.severity and row.recommended_action == text.action
        assert row.description and "{" not in row.description


def issues(people, view, issue):
    return sorted(r.entity_id for r in people.view(view).where(F.col("issue_type") == issue).collect())


def test_workforce_rules_hit_the_right_people(people):
    assert issues(people, "mart_workforce_exceptions", "Missing Manager") == ["E2"]
    assert issues(people, "mart_workforce_exceptions", "Duplicate Employee ID") == ["E6", "E6"]
    assert issues(people, "mart_workforce_exceptions", "Contract Expiry Risk") == ["E7"]
    assert issues(people, "mart_workforce_exceptions", "Iqama Expiry Risk") == ["E8"]
    assert issues(people, "mart_workforce_exceptions", "Inactive Employee Payroll") == ["E10", "E9"]


def test_payroll_rules_hit_the_right_people(people):
    assert issues(people, "mart_payroll_exceptions", "Duplicate Payroll Record") == ["E1"]
    # E1 has a repeated line this month, so its total has doubled.
    assert issues(people, "mart_payroll_exceptions", "Large Payroll Variance") == ["E1", "E8"]
    assert issues(people, "mart_payroll_exceptions", "Overtime Cost Without Hours") == ["E2"]
    assert issues(people, "mart_payroll_exceptions", "Inactive Employee Payroll") == ["E10", "E9", "E99"]


def test_lateness_counts_minute_boundaries(people):
    rows = {(r.employee_id, r.attendance_date.day): r for r in people.view("base_attendance_current").collect()}
    assert rows["E2", 1].calculated_late_minutes == 30
    assert rows["E2", 2].calculated_late_minutes == 5  # 08:00 to 08:20 is 20 boundaries
    assert rows["E2", 2].calculated_net_late_minutes == 0
    assert rows["X1", 1].record_classification == "Unknown employee attendance"
    assert rows["E9", 1].record_classification == "Terminated employee attendance"


def test_expected_days_leave_out_weekend_and_time_before_joining(people):
    days = people.view("base_expected_attendance").groupBy("employee_id").count().collect()
    counts = {r.employee_id: r["count"] for r in days}
    assert counts["E1"] == 26  # June 2026 has 30 days and four Fridays
    assert counts["E13"] == 14  # joined on the 15th
    assert "E9" not in counts and "E10" not in counts


def test_overtime_reconciliation_status(people):
    status = {(r.employee_id, r.reconciliation_status) for r in people.view("base_attendance_payroll_overtime").collect()}
    assert ("E1", "OT in Attendance only") in status and ("E2", "OT in Payroll only") in status and ("E99", "No Overtime") in status


def test_compliance_period_is_part_of_the_join(people):
    rows = [r for r in people.view("base_compliance_current").collect() if r.employee_id == "E2"]
    assert len(rows) == 1 and rows[0].gosi_status == "Pending"


def test_expiry_bucket_edges(people):
    rows = {r.employee_id: r for r in people.view("base_document_expiry").collect()}
    assert rows["E7"].iqama_bucket == "expired" and rows["E8"].iqama_bucket == "0_30"
    assert rows["E8"].work_permit_bucket == "0_30" and rows["E12"].iqama_bucket == "missing_date"


def test_case_clock(people):
    rows = {(r.case_id, r.case_number): r for r in people.view("base_er_case_population").collect()}
    assert ("C12", "N") not in rows  # closed before the month
    clock = rows["C4", "N4"]
    assert str(clock.effective_target_due_date) == "2026-06-11" and clock.sla_status == "Breached" and clock.aging_days == 29
    assert sorted(r.er_case_record_id for r in rows.values()) == list(range(1, len(rows) + 1))


def test_recruitment_population(people):
    assert people.view("base_recruitment_requisitions_current").where("requisition_id = 'Q9'").count() == 0
    canonical = {r.candidate_id: r for r in people.view("base_candidate_canonical").collect()}
    assert canonical["K1"].requisition_id == "Q1" and canonical["K5"].source == "Other"
    kpi = people.view("mart_recruitment_kpis").first()
    assert kpi.offer_acceptance_pct == 66.67 and kpi.hires_this_month == 2 and kpi.approved_vacancies == 1


def test_null_channel_is_optional(people):
    assert issues(people, "mart_recruitment_exceptions", "Unknown Source Channel") == ["K4"]


def test_talent_values(people):
    kpi = people.view("mart_talent_kpis").first()
    assert kpi.employees_reviewed == 4 and kpi.high_performers == 2 and kpi.low_performers == 2
    assert kpi.critical_roles_covered_pct == 33.33 and kpi.ready_successors == 1
    risk = {r.employee_id: r.risk_category for r in people.view("mart_talent_risk").collect()}
    assert risk == {"E1": "High Risk", "E2": "Medium Risk", "E3": "Low Risk", "E8": "Low Risk"}


def test_executive_row(people):
    row = people.view("mart_exec_kpis").first()
    assert row.report_month == "2026-06" and row.active_headcount == 12 and row.joiners_count == 1 and row.leavers_count == 1
    assert row.payroll_cost == 6500 * 7 + 6600 - 100 + 8500


@pytest.mark.parametrize("domain", ["workforce", "payroll", "compliance", "cases", "recruitment", "talent"])
def test_domain_reconciles(people, domain):
    failed = CHECKS[domain](people).where("not passed").collect()
    assert failed == []


def test_failed_check_stops_the_build(people):
    """Clock records of people without a calendar make the attendance totals differ."""
    with pytest.raises(ReconciliationError):
        assert_reconciled(people, ("attendance",))


def test_command_center(people):
    modules = {r.module_key: r for r in people.view("mart_command_center_module_health").collect()}
    assert len(modules) == 9 and modules["executive"].status == "Critical"
    overview = people.view("command_center_overview_data").first()
    assert overview.total_active_exceptions == people.view("base_command_center_exception_sources").count()
    alerts = [r.severity for r in people.view("mart_command_center_priority_alerts").collect()]
    assert alerts == sorted(alerts, key=lambda s: s != "Critical")
    fresh = {r.module_key: r.stale_flag for r in people.view("mart_command_center_data_freshness").collect()}
    assert fresh["attendance"] is False and fresh["er"] is False and len(fresh) == 9


def test_equal_lines_in_both_months_are_no_change(spark):
    from tallyhouse.plans.all import Warehouse
    from tests.people_fixture import tables

    found = tables(spark)
    line = found["payroll"].limit(1).drop("payroll_period", "employee_id", "gross_pay", "basic_salary")
    months = spark.createDataFrame([(m, "E1") for m in ("2024-01", "2024-01", "2023-12", "2023-12")], "payroll_period string, employee_id string")
    lines = months.join(line.selectExpr("*", "5000D AS gross_pay", "3000D AS basic_salary")).select(found["payroll"].columns)
    people = Warehouse(spark, {**found, "payroll": lines})
    assert issues(people, "mart_payroll_exceptions", "Large Payroll Variance") == []
    (row,) = people.view("mart_payroll_variance_employees").collect()
    assert (row.prev_amount, row.curr_amount, row.change_amount) == (10000.0, 10000.0, 0.0)


def test_trends_cover_all_months_of_the_source(people):
    paid = {r[0] for r in people.table("payroll").select("payroll_period").distinct().collect()}
    assert {r.month for r in people.view("mart_exec_trends").collect()} == {m for m in paid if m <= people.payroll_month.label}


def test_counts_build_no_sentences(people):
    plan = people.view("mart_command_center_priority_alerts")._jdf.queryExecution().optimizedPlan().toString()
    counted = people.counted("mart_payroll_exceptions")._jdf.queryExecution().optimizedPlan().toString()
    assert "negative gross pay" not in plan and "negative gross pay" not in counted
    told = people.view("mart_payroll_exceptions").groupBy("issue_type").count().collect()
    assert sorted((r.issue_type, r.n) for r in people.counted("mart_payroll_exceptions").collect()) == sorted((r[0], r[1]) for r in told)
