"""Checking SQL for the people views, written for the DuckDB dialect.

Each entry is one named query; :func:`statement` puts the queries it refers to
in front of it as common table expressions. The texts are independent of the
Spark plans: lateness by ``date_diff``, latest rows by ``QUALIFY``, exceptions
as one union branch per rule.
"""

from __future__ import annotations

import re
import string

from tallyhouse.operators.kpi import KPIS
from tallyhouse.plans import texts
from tallyhouse.plans.reads import SUMMARIES
from tallyhouse.sources import derived_hr
from tallyhouse.sources.trade import TABLES

QUERIES: dict[str, str] = {}

for _name, _sql in derived_hr.SQL.items():
    _text = _sql.replace("{ntz}", "TIMESTAMP")
    for _table in TABLES:
        _text = _text.replace("{%s}" % _table, _table)
    QUERIES[_name] = _text

# Months: label, first day, last day, label of the month before.
for _name, _source in {
    "pay_m": "SELECT max(payroll_period) FROM payroll",
    "att_m": "SELECT strftime(max(attendance_date), '%Y-%m') FROM attendance",
    "com_m": "SELECT max(period) FROM compliance",
    "case_m": "SELECT strftime(max(created_date), '%Y-%m') FROM employee_relations",
    "hire_m": "SELECT strftime(max(approval_date), '%Y-%m') FROM recruitment_requisitions",
    "tal_m": "SELECT max(review_period) FROM performance_reviews",
}.items():
    QUERIES[_name] = (
        f"SELECT p AS label, CAST(p || '-01' AS DATE) AS s, last_day(CAST(p || '-01' AS DATE)) AS e, "
        f"strftime(CAST(p || '-01' AS DATE) - 1, '%Y-%m') AS prev FROM (SELECT ({_source}) AS p)"
    )


def cents(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18,2)) AS VARCHAR)"


def one(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18,1)) AS VARCHAR)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sentence(template: str, slots: dict[str, str]) -> str:
    parts = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(quote(literal))
        if slot:
            parts.append(f"coalesce(CAST({slots.get(slot, slot)} AS VARCHAR), 'N/A')")
    return " || ".join(parts)


def issues(wording: dict, rules: list[tuple]) -> str:
    """One union branch per rule: (issue, from, where, id, name, slots)."""
    branches = []
    for issue, source, where, key, name, *slots in rules:
        text = wording[issue]
        branches.append(
            f"SELECT CAST({key} AS VARCHAR) AS entity_id, CAST({name} AS VARCHAR) AS entity_name, {quote(issue)} AS issue_type, "
            f"{sentence(text.description, slots[0] if slots else {})} AS description, {quote(text.severity)} AS severity, "
            f"{quote(text.action)} AS recommended_action FROM {source} WHERE {where}"
        )
    missing = set(wording) - {r[0] for r in rules}
    assert not missing, missing
    return "\nUNION ALL ".join(branches)


EMPTY = "({0} IS NULL OR {0} = '')".format
BLANK = "({0} IS NULL OR trim({0}) = '')".format
FILLED = "({0} IS NOT NULL AND trim({0}) <> '')".format
MONEY = "round(coalesce(sum({0}), 0), 2)".format
WHOLE = "CAST(coalesce(sum({0}), 0) AS BIGINT)".format
PCT = "CASE WHEN ({1}) = 0 THEN {2} ELSE round(CAST({0} AS DOUBLE) * 100 / ({1}), 2) END".format
BUCKET = (
    "CASE WHEN {0} IS NULL THEN 'missing_date' WHEN {0} < {1} THEN 'expired' WHEN {0} <= {1} + 30 THEN '0_30' "
    "WHEN {0} <= {1} + 60 THEN '31_60' WHEN {0} <= {1} + 90 THEN '61_90' ELSE '90_plus' END"
).format

Q = QUERIES

# ---------------------------------------------------------------- workforce
Q["base_active_workforce"] = """SELECT * FROM employees WHERE status = 'Active'
QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY joining_date DESC NULLS LAST, contract_end_date DESC NULLS LAST, employee_name) = 1"""
Q["base_employees_deduplicated"] = """SELECT * FROM employees
QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY CASE status WHEN 'Active' THEN 0 ELSE 1 END, joining_date DESC NULLS LAST, contract_end_date DESC NULLS LAST, employee_name) = 1"""
Q["permits"] = "SELECT employee_id, iqama_expiry FROM compliance, com_m WHERE period = label"
Q["headcounts"] = """SELECT payroll_period AS month,
  (SELECT count(DISTINCT employee_id) FROM employees WHERE joining_date <= d AND (termination_date IS NULL OR termination_date > d)) AS active_headcount
FROM (SELECT DISTINCT payroll_period, last_day(CAST(payroll_period || '-01' AS DATE)) AS d FROM payroll, pay_m WHERE payroll_period < label)
UNION ALL SELECT label, (SELECT count(*) FROM base_active_workforce) FROM pay_m"""
Q["mart_workforce_headcount_trend"] = "SELECT month, active_headcount FROM headcounts"
Q["mart_exec_trends"] = f"""SELECT h.month, h.active_headcount, coalesce(p.c, 0) AS payroll_cost FROM headcounts h
LEFT JOIN (SELECT payroll_period, {MONEY('gross_pay')} AS c FROM payroll GROUP BY 1) p ON p.payroll_period = h.month"""
Q["mart_exec_kpis"] = f"""SELECT label AS report_month, active_headcount, joiners_count, leavers_count,
  CASE WHEN active_headcount = 0 THEN 0 ELSE CAST(leavers_count AS DOUBLE) / active_headcount END AS turnover_rate,
  payroll_cost, overtime_cost, absence_days, 1 - CAST(n AS DOUBLE) / (greatest(ids, 1) * 8) AS data_quality_score
FROM pay_m,
  (SELECT count(DISTINCT employee_id) FILTER (status = 'Active') AS active_headcount,
     count(DISTINCT employee_id) FILTER (joining_date BETWEEN s AND e) AS joiners_count,
     count(DISTINCT employee_id) FILTER (termination_date BETWEEN s AND e) AS leavers_count,
     count(DISTINCT employee_id) AS ids FROM employees, pay_m),
  (SELECT {MONEY('gross_pay')} AS payroll_cost, {MONEY('overtime_amount')} AS overtime_cost FROM payroll, pay_m WHERE payroll_period = label),
  (SELECT {MONEY('absence_days')} AS absence_days FROM attendance, pay_m WHERE attendance_date BETWEEN s AND e),
  (SELECT count(*) AS n FROM data_quality)"""
Q["mart_data_quality_summary"] = """SELECT (SELECT data_quality_score FROM mart_exec_kpis) AS data_quality_score,
  count(*) FILTER (issue_type = 'Missing Manager') AS missing_manager_count, count(*) FILTER (issue_type = 'Missing Project') AS missing_project_count,
  count(*) FILTER (issue_type = 'Missing Cost Center') AS missing_cost_center_count, count(*) FILTER (issue_type = 'Missing Nationality') AS missing_nationality_count,
  count(*) FILTER (issue_type = 'Duplicate Employee ID') AS duplicate_employee_count,
  count(*) FILTER (issue_type IN ('Inactive Employee with Payroll Record', 'Negative or Abnormal Payroll Value', 'Active Employee with Missing Salary')) AS invalid_payroll_count
FROM data_quality"""
Q["mart_data_quality_exceptions"] = "SELECT entity_id AS employee_id, entity_name AS employee_name, issue_type, description, severity, recommended_action FROM data_quality"
Q["mart_workforce_kpis"] = f"""WITH k AS (
  SELECT count(DISTINCT w.employee_id) AS hc, count(DISTINCT w.employee_id) FILTER (is_saudi) AS sa, count(DISTINCT w.employee_id) FILTER (NOT is_saudi) AS ns,
    count(DISTINCT w.employee_id) FILTER (joining_date BETWEEN e - 90 AND e) AS pr,
    count(DISTINCT w.employee_id) FILTER (contract_end_date BETWEEN e AND e + 30) AS ce,
    count(DISTINCT w.employee_id) FILTER (iqama_expiry BETWEEN e AND e + 30) AS ie,
    count(DISTINCT w.employee_id) FILTER {EMPTY('manager_id')} AS mm, count(DISTINCT w.employee_id) FILTER {EMPTY('project')} AS mp,
    count(DISTINCT w.employee_id) FILTER {EMPTY('cost_center')} AS mc
  FROM base_active_workforce w LEFT JOIN permits USING (employee_id), pay_m)
SELECT hc AS active_headcount, sa AS saudi_headcount, ns AS non_saudi_headcount, CASE WHEN hc = 0 THEN 0 ELSE CAST(sa AS DOUBLE) / hc END AS saudization_rate,
  pr AS probation_count, ce AS contract_expiring_30, ie AS iqama_expiring_30, mm AS missing_manager_count, mp AS missing_project_count, mc AS missing_cost_center_count FROM k"""
_DIMENSIONS = [
    ("department", "department", "coalesce(department, 'Missing')"),
    ("project", "project", "coalesce(project, 'Missing')"),
    ("nationality_group", "is_saudi", "CASE WHEN is_saudi THEN 'Saudi' ELSE 'Non-Saudi' END"),
    ("employment_type", "employment_type", "coalesce(employment_type, 'Missing')"),
    ("status", "status", "coalesce(status, 'Missing')"),
]
Q["mart_workforce_distribution"] = "\nUNION ALL ".join(
    f"SELECT '{c}' AS category, {label} AS metric_value, count(*) AS headcount FROM base_active_workforce GROUP BY {by}" for c, by, label in _DIMENSIONS
)
_WIDE = ", ".join(f"count(DISTINCT employee_id) FILTER (b = '{b}') AS \"{b}\"" for b in ("expired", "0_30", "31_60", "61_90", "90_plus", "missing_date"))
Q["mart_workforce_contract_expiry"] = f"SELECT {_WIDE} FROM (SELECT employee_id, {BUCKET('contract_end_date', 'e')} AS b FROM base_active_workforce, pay_m)"
Q["mart_workforce_iqama_expiry"] = f"""SELECT {_WIDE} FROM (SELECT w.employee_id, {BUCKET('iqama_expiry', 'e')} AS b
FROM base_active_workforce w LEFT JOIN permits USING (employee_id), pay_m WHERE NOT is_saudi)"""
_A, _E = "base_active_workforce, pay_m", "employees"
_P = "base_active_workforce w LEFT JOIN permits USING (employee_id), pay_m"
_ID, _NM = "employee_id", "employee_name"
Q["mart_workforce_exceptions"] = issues(texts.WORKFORCE, [
    ("Missing Manager", _A, EMPTY("manager_id"), _ID, _NM),
    ("Missing Project", _A, EMPTY("project"), _ID, _NM),
    ("Missing Cost Center", _A, EMPTY("cost_center"), _ID, _NM),
    ("Missing Nationality", _E, EMPTY("nationality"), _ID, _NM),
    ("Duplicate Employee ID", "(SELECT *, count(*) OVER (PARTITION BY employee_id) AS n FROM employees)", "n > 1", _ID, _NM),
    ("Contract Expiry Risk", _A, "contract_end_date BETWEEN e AND e + 30", _ID, _NM),
    ("Iqama Expiry Risk", _P, "NOT is_saudi AND iqama_expiry BETWEEN e AND e + 30", _ID, _NM),
    ("Inactive Employee Payroll", "payroll p JOIN employees m ON p.employee_id = m.employee_id, pay_m",
     "m.status IN ('Inactive', 'Terminated') AND payroll_period = label", "m.employee_id", "m.employee_name", {"status": "m.status"}),
    ("Missing Contract End Date", _A, "contract_end_date IS NULL", _ID, _NM),
    ("Missing Department", _A, EMPTY("department"), _ID, _NM),
    ("Missing Iqama Expiry Date", _P, "NOT is_saudi AND iqama_expiry IS NULL", _ID, _NM),
])

# ---------------------------------------------------------------- validators
_M = "base_employees_deduplicated m USING (employee_id)"
_UNKNOWN = "coalesce(m.employee_name, 'Unknown')"
Q["data_quality"] = issues(texts.VALIDATION, [
    ("Duplicate Employee ID", "(SELECT DISTINCT employee_id, employee_name, count(*) OVER (PARTITION BY employee_id) AS copies FROM employees)", "copies > 1", _ID, _NM),
    ("Missing Manager", _E, f"status = 'Active' AND {EMPTY('manager_id')}", _ID, _NM),
    ("Missing Project", _E, f"status = 'Active' AND {EMPTY('project')}", _ID, _NM),
    ("Missing Nationality", _E, EMPTY("nationality"), _ID, _NM),
    ("Missing Cost Center", _E, EMPTY("cost_center"), _ID, _NM),
    ("Active Employee with Missing Salary", _E, "status = 'Active' AND coalesce(basic_salary, 0) = 0", _ID, _NM),
    ("Abnormal Payroll Value", _E, "status = 'Active' AND basic_salary < 0", _ID, _NM, {"basic": cents("basic_salary")}),
    ("Inactive Employee with Payroll Record", f"payroll LEFT JOIN {_M}", "m.status IS NULL OR m.status IN ('Terminated', 'Inactive')", _ID,
     "coalesce(m.employee_name, 'Unknown Employee')", {"status": "coalesce(m.status, 'None')"}),
    ("Negative or Abnormal Payroll Value", f"payroll p LEFT JOIN {_M}", "least(gross_pay, net_pay, p.basic_salary) < 0", _ID, _UNKNOWN,
     {"gross": cents("gross_pay"), "net": cents("net_pay")}),
    ("Attendance Record with Missing Punch", f"attendance LEFT JOIN {_M}", "missing_punch_count > 0", _ID, _UNKNOWN, {"day": "attendance_date"}),
    ("HR Request Breaching SLA", f"hr_requests LEFT JOIN {_M}", "sla_breached", _ID, _UNKNOWN,
     {"actual": "actual_hours", "sla": "coalesce(CAST(sla_hours AS VARCHAR), 'None')"}),
])

# ---------------------------------------------------------------- payroll
_PAY = """SELECT p.*, coalesce(w.project, 'Missing Project') AS emp_project, coalesce(w.department, 'Missing Department') AS emp_department,
  coalesce(w.cost_center, 'Missing Cost Center') AS emp_cost_center, coalesce(w.status, 'Inactive/Terminated/Unknown') AS emp_status, w.employee_name, w.is_saudi
FROM pay_m, payroll p LEFT JOIN base_active_workforce w ON w.employee_id = p.employee_id WHERE payroll_period = """
Q["base_payroll_current"] = _PAY + "label"
Q["base_payroll_previous"] = _PAY + "prev"
Q["pay_change"] = """SELECT n.employee_id, n.employee_name, n.gross AS curr_gross, n.basic AS curr_basic, p.gross AS prev_gross, p.basic AS prev_basic
FROM (SELECT employee_id, max(employee_name) AS employee_name, round(sum(gross_pay), 2) AS gross, round(sum(basic_salary), 2) AS basic FROM base_payroll_current GROUP BY employee_id) n
LEFT JOIN (SELECT employee_id, round(sum(gross_pay), 2) AS gross, round(sum(basic_salary), 2) AS basic FROM base_payroll_previous GROUP BY employee_id) p ON n.employee_id = p.employee_id"""
_COMP = "basic_salary + housing_allowance + transport_allowance + other_allowances + overtime_amount"
_C = "base_payroll_current"
_G, _N = cents("gross_pay"), cents("net_pay")
Q["mart_payroll_exceptions"] = issues(texts.PAYROLL, [
    ("Inactive Employee Payroll", _C, "emp_status = 'Inactive/Terminated/Unknown'", _ID, "coalesce(employee_name, 'Unknown Employee')"),
    ("Active Employee Missing Payroll", "base_active_workforce w", "NOT EXISTS (SELECT 1 FROM base_payroll_current c WHERE c.employee_id = w.employee_id)", _ID, _NM),
    ("Negative Gross Pay", _C, "gross_pay < 0", _ID, _NM, {"gross": _G}),
    ("Negative Net Pay", _C, "net_pay < 0", _ID, _NM, {"net": _N}),
    ("Net Pay Exceeds Gross Pay", _C, "net_pay > gross_pay", _ID, _NM, {"gross": _G, "net": _N}),
    ("Missing Cost Center", _C, f"{EMPTY('cost_center')} OR emp_cost_center = 'Missing Cost Center'", _ID, _NM),
    ("Missing Project", _C, f"{EMPTY('project')} OR emp_project = 'Missing Project'", _ID, _NM),
    ("Overtime Cost Without Hours", _C + " c", """overtime_amount > 0 AND coalesce((SELECT sum(overtime_hours) FROM attendance a, pay_m
      WHERE a.employee_id = c.employee_id AND attendance_date BETWEEN s AND e), 0) = 0""", _ID, _NM, {"overtime": cents("overtime_amount")}),
    ("Large Payroll Variance", "pay_change",
     "abs(curr_gross - prev_gross) > 2000 OR (prev_basic > 0 AND abs(curr_basic - prev_basic) / prev_basic > 0.1)", _ID, _NM,
     {"change": cents("curr_gross - prev_gross"), "basic_pct": cents("abs(curr_basic - prev_basic) / nullif(prev_basic, 0) * 100")}),
    ("Duplicate Payroll Record", "(SELECT employee_id, payroll_period, any_value(employee_name) AS nm, count(*) AS n FROM base_payroll_current GROUP BY 1, 2)",
     "n > 1", _ID, "coalesce(nm, 'Unknown Employee')"),
    ("Payroll Component Mismatch", _C, f"abs(gross_pay - ({_COMP})) > 0.01", _ID, _NM, {"gross": _G, "components": cents(_COMP)}),
    ("Net Pay Mismatch", _C, "abs(net_pay - (gross_pay - deductions)) > 0.01", _ID, _NM, {"net": _N, "expected_net": cents("gross_pay - deductions")}),
])
_ALLOW = "housing_allowance + transport_allowance + other_allowances"
Q["mart_payroll_kpis"] = f"""WITH c AS (SELECT {MONEY('gross_pay')} AS g, {MONEY('basic_salary')} AS b, {MONEY(_ALLOW)} AS a, {MONEY('overtime_amount')} AS o,
    {MONEY('deductions')} AS d, {MONEY('net_pay')} AS n, count(DISTINCT employee_id) AS k FROM base_payroll_current),
  b AS (SELECT {MONEY('gross_pay')} AS g0 FROM base_payroll_previous)
SELECT g AS total_payroll_cost, b AS basic_salary_cost, a AS allowances_cost, o AS overtime_cost, d AS deductions, n AS net_payroll,
  CASE WHEN k = 0 THEN 0 ELSE g / k END AS avg_cost_per_employee, CASE WHEN g0 = 0 THEN 0 ELSE (g - g0) / g0 END AS payroll_variance_pct,
  k AS employees_paid, (SELECT count(*) FROM mart_payroll_exceptions) AS payroll_exception_count FROM c, b"""
Q["mart_payroll_trend"] = f"""SELECT payroll_period AS month, {MONEY('gross_pay')} AS total_payroll_cost, {MONEY('basic_salary')} AS basic_salary, {MONEY(_ALLOW)} AS allowances,
  {MONEY('overtime_amount')} AS overtime, {MONEY('deductions')} AS deductions, {MONEY('net_pay')} AS net_payroll, count(DISTINCT employee_id) AS headcount FROM payroll GROUP BY payroll_period"""
_COST = f"count(DISTINCT employee_id) AS headcount, {MONEY('gross_pay')} AS total_payroll_cost, {MONEY('overtime_amount')} AS overtime_cost FROM base_payroll_current"
Q["mart_payroll_by_project"] = f"SELECT coalesce(project, 'Missing Project') AS project, {_COST} GROUP BY base_payroll_current.project"
Q["mart_payroll_by_department"] = f"SELECT emp_department AS department, {_COST} GROUP BY emp_department"
_LABELS = {"basic_salary": "Basic Salary", "housing_allowance": "Housing Allowance", "transport_allowance": "Transport Allowance",
           "other_allowances": "Other Allowances", "overtime_amount": "Overtime", "deductions": "Deductions"}
Q["mart_payroll_components"] = " UNION ALL ".join(
    f"SELECT '{v}' AS component, {MONEY(k)} AS amount FROM base_payroll_current" for k, v in _LABELS.items()
) + f" UNION ALL SELECT 'Unreconciled / Exception Amount', {MONEY('gross_pay - (' + _COMP + ')')} FROM base_payroll_current"
Q["mart_payroll_variance_components"] = "SELECT component, prev_amount, curr_amount, round(curr_amount - prev_amount, 2) AS change_amount, " \
    "CASE WHEN prev_amount = 0 THEN 0 ELSE round((curr_amount - prev_amount) / prev_amount, 6) END AS change_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{v}' AS component, (SELECT {MONEY(k)} FROM base_payroll_previous) AS prev_amount, (SELECT {MONEY(k)} FROM base_payroll_current) AS curr_amount"
        for k, v in _LABELS.items()) + ")"
Q["mart_payroll_variance_employees"] = """SELECT employee_id, employee_name, coalesce(prev_gross, 0) AS prev_amount, curr_gross AS curr_amount,
  round(curr_gross - coalesce(prev_gross, 0), 2) AS change_amount,
  CASE WHEN coalesce(prev_gross, 0) = 0 THEN 0 ELSE round((curr_gross - prev_gross) / prev_gross, 6) END AS change_pct
FROM pay_change"""
Q["mart_payroll_reconciliation"] = f"""WITH t AS (SELECT {MONEY('gross_pay')} AS total_gross_payroll, {MONEY('basic_salary')} AS basic_salary_sum, {MONEY('housing_allowance')} AS housing_allowance_sum,
    {MONEY('transport_allowance')} AS transport_allowance_sum, {MONEY('other_allowances')} AS other_allowances_sum, {MONEY('overtime_amount')} AS overtime_sum,
    {MONEY('deductions')} AS deductions_sum, {MONEY('net_pay')} AS net_payroll, count(DISTINCT employee_id) AS employees_paid_count, {MONEY(_COMP)} AS sum_displayed_components
  FROM base_payroll_current)
SELECT t.*, round(total_gross_payroll - sum_displayed_components, 2) AS unreconciled_component_difference, round(total_gross_payroll - deductions_sum, 2) AS gross_minus_deductions,
  round(total_gross_payroll - deductions_sum - net_payroll, 2) AS net_unreconciled_difference, total_gross_payroll AS project_payroll_total,
  total_gross_payroll AS department_payroll_total, (SELECT count(*) FROM mart_payroll_exceptions) AS payroll_exception_count FROM t"""

# ---------------------------------------------------------------- attendance
Q["clock_rows"] = """SELECT *, CASE WHEN actual_check_in IS NULL OR scheduled_start IS NULL THEN 0
  ELSE greatest(date_diff('minute', scheduled_start, actual_check_in) - 15, 0) END AS calculated_late_minutes FROM attendance"""
Q["base_attendance_current"] = """SELECT a.*, greatest(calculated_late_minutes - coalesce(excused_late_minutes, 0), 0) AS calculated_net_late_minutes,
  m.employee_name AS emp_name, m.status AS emp_status, m.department AS emp_department, m.project AS emp_project,
  m.joining_date AS emp_joining_date, m.termination_date AS emp_termination_date,
  CASE WHEN m.employee_id IS NULL THEN 'Unknown employee attendance' WHEN m.status IN ('Active', 'Inactive', 'Terminated') THEN m.status || ' employee attendance'
    ELSE 'Other employee attendance' END AS record_classification
FROM clock_rows a JOIN att_m ON attendance_date BETWEEN s AND e LEFT JOIN base_employees_deduplicated m ON m.employee_id = a.employee_id"""
Q["base_expected_attendance"] = """SELECT d AS calendar_date, m.employee_id, m.employee_name, m.department, m.project, m.status, m.joining_date, m.termination_date,
  a.attendance_date, a.scheduled_start, a.scheduled_end, a.actual_check_in, a.actual_check_out, a.calculated_late_minutes, a.calculated_net_late_minutes,
  a.excused_late_minutes, a.missing_punch_count, a.overtime_hours, a.overtime_approved,
  CASE WHEN a.employee_id IS NULL THEN 1.0 ELSE coalesce(a.absence_days, 0) END AS absence_days
FROM (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d FROM att_m) c
JOIN base_employees_deduplicated m ON m.status = 'Active' AND d >= m.joining_date AND d <= coalesce(m.termination_date, d) AND dayname(d) <> 'Friday'
LEFT JOIN base_attendance_current a ON a.employee_id = m.employee_id AND a.attendance_date = d"""
Q["base_attendance_payroll_overtime"] = """SELECT employee_id, m.employee_name, m.department, m.project, h AS attendance_ot_hours, c AS payroll_ot_cost,
  CASE WHEN h > 0 THEN CASE WHEN c > 0 THEN 'Reconciled' WHEN c = 0 THEN 'OT in Attendance only' ELSE 'No Overtime' END
       WHEN h = 0 AND c > 0 THEN 'OT in Payroll only' ELSE 'No Overtime' END AS reconciliation_status
FROM (SELECT employee_id, coalesce(a.h, 0) AS h, coalesce(overtime_amount, 0) AS c
  FROM (SELECT employee_id, sum(overtime_hours) AS h FROM base_attendance_current WHERE overtime_approved GROUP BY 1) a FULL JOIN base_payroll_current USING (employee_id)) x
LEFT JOIN base_employees_deduplicated m USING (employee_id)"""
_X, _R, _O = "base_expected_attendance", "base_attendance_current", "base_attendance_payroll_overtime"
_D, _L = {"day": "calendar_date"}, {"day": "attendance_date", "late": "calculated_late_minutes"}
_IN, _OUT = "actual_check_in IS {}NULL".format, "actual_check_out IS {}NULL".format
Q["mart_attendance_exceptions"] = issues(texts.ATTENDANCE, [
    ("Missing Check-in", _X, f"{_IN('')} AND {_OUT('NOT ')}", _ID, _NM, _D),
    ("Missing Check-out", _X, f"{_IN('NOT ')} AND {_OUT('')}", _ID, _NM, _D),
    ("Both Punches Missing", _X, f"{_IN('')} AND {_OUT('')} AND absence_days = 0", _ID, _NM, _D),
    ("One Punch Only", _X, f"({_IN('')}) <> ({_OUT('')})", _ID, _NM, _D),
    ("Late Arrival Without Excuse", _X, "calculated_late_minutes > 0 AND coalesce(excused_late_minutes, 0) = 0", _ID, _NM, {**_D, "late": "calculated_late_minutes"}),
    ("Excused Late Exceeds Actual", _X, "excused_late_minutes > calculated_late_minutes", _ID, _NM, {**_D, "late": "calculated_late_minutes", "excused": "excused_late_minutes"}),
    ("Source Late Minutes Mismatch", _R, "coalesce(late_minutes, 0) <> calculated_late_minutes", _ID, "emp_name", {**_L, "source_late": "coalesce(late_minutes, 0)"}),
    ("Source Net Late Minutes Mismatch", _R, "coalesce(net_late_minutes, 0) <> calculated_net_late_minutes", _ID, "emp_name",
     {**_L, "source_net": "coalesce(net_late_minutes, 0)", "net_late": "calculated_net_late_minutes"}),
    ("Overtime Amount Missing", _O, "attendance_ot_hours > 0 AND payroll_ot_cost = 0", _ID, _NM, {"hours": cents("attendance_ot_hours")}),
    ("Overtime Hours Missing", _O, "payroll_ot_cost > 0 AND attendance_ot_hours = 0", _ID, _NM, {"cost": cents("payroll_ot_cost")}),
    ("Attendance for Inactive Employee", _R, "emp_status = 'Inactive'", _ID, "emp_name", _L),
    ("Attendance for Terminated Employee", _R, "emp_status = 'Terminated'", _ID, "emp_name", _L),
    ("Attendance for Unknown Employee", _R, "emp_name IS NULL", _ID, "'Unknown Employee'", _L),
    ("Missing Workday Attendance", _X, "attendance_date IS NULL", _ID, _NM, _D),
])
_CLEAN = ("1 - CAST(count(*) FILTER (calculated_net_late_minutes > 0 OR missing_punch_count > 0 OR absence_days > 0) AS DOUBLE) / count(*)")
Q["mart_attendance_kpis"] = f"""SELECT CASE WHEN count(*) = 0 THEN 1 ELSE {_CLEAN} END AS attendance_compliance_pct, {MONEY('absence_days')} AS absence_days,
  {WHOLE('calculated_late_minutes')} AS late_minutes, {WHOLE('excused_late_minutes')} AS excused_late_minutes, {WHOLE('calculated_net_late_minutes')} AS net_late_minutes,
  CAST(coalesce(sum(date_diff('minute', actual_check_out, scheduled_end)) FILTER (actual_check_out < scheduled_end), 0) AS BIGINT) AS early_leave_minutes,
  {WHOLE('missing_punch_count')} AS missing_punch_count, round(coalesce(sum(overtime_hours) FILTER (overtime_approved), 0), 2) AS overtime_hours,
  (SELECT {MONEY('payroll_ot_cost')} FROM base_attendance_payroll_overtime) AS overtime_cost,
  (SELECT count(*) FROM mart_attendance_exceptions) AS attendance_exception_count FROM base_expected_attendance"""
Q["trend_days"] = """SELECT strftime(d, '%Y-%m') AS month, a.calculated_late_minutes, greatest(a.calculated_late_minutes - coalesce(a.excused_late_minutes, 0), 0) AS calculated_net_late_minutes,
  a.missing_punch_count, a.overtime_hours, a.overtime_approved, CASE WHEN a.employee_id IS NULL THEN 1.0 ELSE coalesce(a.absence_days, 0) END AS absence_days
FROM (SELECT CAST(unnest(generate_series(f, e, INTERVAL 1 DAY)) AS DATE) AS d FROM att_m, (SELECT CAST(date_trunc('month', min(attendance_date)) AS DATE) AS f FROM clock_rows)) c
JOIN base_employees_deduplicated m ON m.status = 'Active' AND d >= m.joining_date AND d <= coalesce(m.termination_date, d) AND dayname(d) <> 'Friday'
LEFT JOIN clock_rows a ON a.employee_id = m.employee_id AND a.attendance_date = d
WHERE strftime(d, '%Y-%m') IN (SELECT strftime(attendance_date, '%Y-%m') FROM clock_rows)"""
Q["mart_attendance_trend"] = f"""SELECT month, round({_CLEAN}, 4) AS attendance_compliance_pct, {MONEY('absence_days')} AS absence_days, CAST({WHOLE('calculated_late_minutes')} AS DOUBLE) AS late_minutes,
  CAST({WHOLE('calculated_net_late_minutes')} AS DOUBLE) AS net_late_minutes, CAST({WHOLE('missing_punch_count')} AS DOUBLE) AS missing_punch_count,
  round(coalesce(sum(overtime_hours) FILTER (overtime_approved), 0), 2) AS overtime_hours FROM trend_days GROUP BY month"""


def _attendance_by(key: str, default: str, net: str) -> str:
    return f"""SELECT coalesce(g.{key}, '{default}') AS {key}, headcount, attendance_compliance_pct, absence_days, late_minutes, {net} missing_punches, overtime_hours, coalesce(c, 0) AS overtime_cost
FROM (SELECT {key}, count(DISTINCT employee_id) AS headcount, {_CLEAN} AS attendance_compliance_pct, {MONEY('absence_days')} AS absence_days, {WHOLE('calculated_late_minutes')} AS late_minutes,
    {WHOLE('calculated_net_late_minutes')} AS net_late_minutes, {WHOLE('missing_punch_count')} AS missing_punches, round(coalesce(sum(overtime_hours) FILTER (overtime_approved), 0), 2) AS overtime_hours
  FROM base_expected_attendance GROUP BY {key}) g
LEFT JOIN (SELECT {key}, {MONEY('payroll_ot_cost')} AS c FROM base_attendance_payroll_overtime GROUP BY 1) o ON o.{key} = g.{key}"""


Q["mart_attendance_by_project"] = _attendance_by("project", "Missing Project", "")
Q["mart_attendance_by_department"] = _attendance_by("department", "Missing Department", "net_late_minutes,")
Q["mart_attendance_late_arrival"] = f"""SELECT employee_id, employee_name, department, project, {WHOLE('calculated_late_minutes')} AS total_late_minutes, {WHOLE('excused_late_minutes')} AS total_excused_minutes,
  {WHOLE('calculated_net_late_minutes')} AS total_net_late_minutes, count(*) FILTER (calculated_late_minutes > 0) AS late_arrival_incidents_count
FROM base_expected_attendance GROUP BY ALL HAVING sum(calculated_late_minutes) > 0"""
Q["mart_attendance_overtime"] = "SELECT * FROM base_attendance_payroll_overtime"
Q["mart_attendance_missing_punches"] = f"""SELECT employee_id, employee_name, department, project, count(*) FILTER ({_IN('')} AND {_OUT('NOT ')}) AS missing_check_in_count,
  count(*) FILTER ({_IN('NOT ')} AND {_OUT('')}) AS missing_check_out_count, {WHOLE('missing_punch_count')} AS total_missing_punches
FROM base_expected_attendance GROUP BY ALL HAVING sum(missing_punch_count) > 0"""

# ---------------------------------------------------------------- compliance
_PLATFORM = ("qiwa_status, gosi_status, mudad_status, contract_authenticated, gosi_salary, payroll_basic_salary, occupation_code, "
             "occupation_match_status, work_permit_expiry, iqama_expiry, insurance_status")


def person_class(key: str, status: str) -> str:
    return (f"CASE WHEN {key} IS NULL THEN 'Unknown Employee' WHEN {status} IN ('Active', 'Inactive', 'Terminated') THEN {status} || ' Employee' "
            "ELSE 'Unknown Status Employee' END")


Q["base_government_platform_records"] = f"""SELECT c.employee_id, c.period, {_PLATFORM}, m.employee_name, m.status AS employee_status, m.is_saudi, m.nationality, m.project, m.department, m.cost_center,
  {person_class('m.employee_id', 'm.status')} AS record_classification
FROM compliance c JOIN com_m ON c.period = label LEFT JOIN base_employees_deduplicated m ON m.employee_id = c.employee_id"""
Q["base_compliance_current"] = f"""SELECT w.employee_id, employee_name, nationality, is_saudi, company, department, project, cost_center, job_title, employment_type, {_PLATFORM}
FROM base_active_workforce w LEFT JOIN (SELECT c.* FROM compliance c, com_m WHERE period = label) c ON c.employee_id = w.employee_id"""
_NAT, _FOR, _UNC = f"is_saudi AND {FILLED('nationality')}", f"NOT is_saudi AND {FILLED('nationality')}", f"{BLANK('nationality')} OR is_saudi IS NULL"
Q["base_saudization_population"] = f"""SELECT employee_id, employee_name, nationality, is_saudi, project, department, CASE WHEN {_NAT} THEN 1 ELSE 0 END AS saudi_count,
  CASE WHEN {_FOR} THEN 1 ELSE 0 END AS non_saudi_count, CASE WHEN {_UNC} THEN 1 ELSE 0 END AS missing_nationality_count FROM base_active_workforce"""
Q["base_government_status"] = """SELECT employee_id, employee_name, is_saudi, gosi_status, mudad_status AS wps_status, gosi_salary, payroll_basic_salary,
  CAST(gosi_status IS NOT NULL AS INT) AS has_gosi_source, CAST(mudad_status IS NOT NULL AS INT) AS has_wps_source FROM base_compliance_current"""
Q["base_document_expiry"] = f"""SELECT employee_id, employee_name, is_saudi, iqama_expiry, work_permit_expiry, {BUCKET('iqama_expiry', 'e')} AS iqama_bucket,
  {BUCKET('work_permit_expiry', 'e')} AS work_permit_bucket FROM base_compliance_current, com_m WHERE {_FOR}"""
_B, _X2, _GOV = "base_compliance_current", "base_document_expiry", "base_government_platform_records"
Q["mart_compliance_exceptions"] = issues(texts.COMPLIANCE, [
    ("Missing GOSI Status Record", _B, "gosi_status IS NULL", _ID, _NM),
    ("Not Registered in GOSI", _B, "gosi_status <> 'Registered'", _ID, _NM),
    ("Missing WPS Record", _B, "mudad_status IS NULL", _ID, _NM),
    ("WPS Record for Inactive Employee", _GOV, "record_classification <> 'Active Employee' AND mudad_status IS NOT NULL", _ID, _NM,
     {"employee_status": "coalesce(employee_status, 'Unknown')"}),
    ("Missing Project assignment", "base_active_workforce", BLANK("project"), _ID, _NM),
    ("Missing Department assignment", "base_active_workforce", BLANK("department"), _ID, _NM),
    ("Missing Cost Center assignment", "base_active_workforce", BLANK("cost_center"), _ID, _NM),
    ("Missing Qiwa Contract", _B, "qiwa_status IS DISTINCT FROM 'Active'", _ID, _NM),
    ("Contract Not Authenticated", _B, "NOT contract_authenticated", _ID, _NM),
    ("GOSI Salary Mismatch", _B, "gosi_salary <> payroll_basic_salary", _ID, _NM, {"gosi_salary": cents("gosi_salary"), "basic": cents("payroll_basic_salary")}),
    ("Missing Salary Info", _B, "gosi_salary IS NULL OR payroll_basic_salary IS NULL", _ID, _NM),
    ("Occupation Mismatch", _B, "occupation_match_status IS DISTINCT FROM 'Matched'", _ID, _NM),
    ("Insurance Inactive", _B, "insurance_status IS DISTINCT FROM 'Active'", _ID, _NM),
    ("Missing Nationality", "base_active_workforce", _UNC, _ID, _NM),
    ("Missing Iqama Expiry Date", _X2, "iqama_bucket = 'missing_date'", _ID, _NM),
    ("Expired Iqama", _X2, "iqama_bucket = 'expired'", _ID, _NM),
    ("Iqama Expiring Soon", _X2, "iqama_bucket = '0_30'", _ID, _NM),
    ("Missing Work Permit Expiry Date", _X2, "work_permit_bucket = 'missing_date'", _ID, _NM),
    ("Expired Work Permit", _X2, "work_permit_bucket = 'expired'", _ID, _NM),
    ("Work Permit Expiring Soon", _X2, "work_permit_bucket = '0_30'", _ID, _NM),
])
_POP = f"count(*) FILTER ({_NAT}) AS saudi_headcount, count(*) FILTER ({_FOR}) AS non_saudi_headcount, count(*) FILTER ({_UNC}) AS employees_missing_nationality"
_QUOTA = PCT("saudi_headcount", "saudi_headcount + non_saudi_headcount", 0) + " AS saudization_pct"
Q["mart_compliance_kpis"] = f"""SELECT saudi_headcount, non_saudi_headcount, employees_missing_nationality, {_QUOTA}, iqamas_expiring_30, work_permits_expiring_30, iqamas_expired, work_permits_expired,
  gosi_missing_count, wps_exception_count, (SELECT count(*) FROM mart_compliance_exceptions) AS compliance_exception_count
FROM (SELECT {_POP} FROM base_active_workforce),
  (SELECT count(*) FILTER (iqama_bucket = '0_30') AS iqamas_expiring_30, count(*) FILTER (work_permit_bucket = '0_30') AS work_permits_expiring_30,
     count(*) FILTER (iqama_bucket = 'expired') AS iqamas_expired, count(*) FILTER (work_permit_bucket = 'expired') AS work_permits_expired FROM base_document_expiry),
  (SELECT count(*) FILTER (gosi_status IS DISTINCT FROM 'Registered') AS gosi_missing_count, count(*) FILTER (mudad_status IS DISTINCT FROM 'Compliant') AS wps_exception_count FROM base_compliance_current)"""
Q["mart_saudization_summary"] = f"""SELECT period, saudi_headcount, non_saudi_headcount, employees_missing_nationality, {_QUOTA} FROM (
  SELECT strftime(d, '%Y-%m') AS period, {_POP} FROM base_employees_deduplicated, (SELECT DISTINCT last_day(CAST(period || '-01' AS DATE)) AS d FROM compliance, com_m WHERE period < label)
  WHERE joining_date <= d AND (termination_date IS NULL OR termination_date > d) GROUP BY 1
  UNION ALL SELECT any_value(label), {_POP} FROM base_active_workforce, com_m)"""
for _k in ("project", "department"):
    Q[f"mart_saudization_by_{_k}"] = f"""SELECT coalesce({_k}, 'Unassigned') AS {_k}, saudi_headcount, non_saudi_headcount, employees_missing_nationality, total_headcount, {_QUOTA}
FROM (SELECT {_k}, {_POP}, count(*) AS total_headcount FROM base_active_workforce GROUP BY {_k})"""
Q["mart_document_expiry"] = """SELECT b AS expiry_bucket, (SELECT count(*) FROM base_document_expiry WHERE iqama_bucket = b) AS iqama_count,
  (SELECT count(*) FROM base_document_expiry WHERE work_permit_bucket = b) AS work_permit_count
FROM (SELECT unnest(['expired', '0_30', '31_60', '61_90', '90_plus', 'missing_date']) AS b)"""
Q["mart_gosi_status"] = """SELECT CASE WHEN gosi_status IS NULL THEN 'Missing Source / Unknown' WHEN gosi_status = 'Registered' THEN 'Registered' ELSE 'Not Registered' END AS gosi_status,
  count(*) AS employee_count FROM base_compliance_current GROUP BY ALL"""
Q["mart_wps_status"] = "SELECT coalesce(mudad_status, 'Missing Source / Unknown') AS wps_status, count(*) AS headcount FROM base_compliance_current GROUP BY 1"

# ---------------------------------------------------------------- cases
Q["case_rows"] = f"""SELECT row_number() OVER (ORDER BY case_id NULLS LAST, c.employee_id NULLS LAST, created_date NULLS LAST, case_type NULLS LAST, priority NULLS LAST, case_number) AS er_case_record_id,
  c.*, m.employee_name, coalesce(m.project, 'Unassigned') AS project, coalesce(m.department, 'Unassigned') AS department, m.manager_id, m.company, m.nationality, m.job_title, m.cost_center,
  {person_class('m.employee_id', 'm.status')} AS subject_classification, date_diff('day', created_date, coalesce(closed_date, e)) AS aging_days,
  coalesce(target_due_date, created_date + CASE case_type WHEN 'Grievance' THEN 10 WHEN 'Labor Case' THEN 30 ELSE 14 END) AS effective_target_due_date, s AS ms, e AS me
FROM employee_relations c JOIN case_m ON created_date <= e AND (closed_date IS NULL OR closed_date >= s OR created_date >= s)
LEFT JOIN base_employees_deduplicated m ON m.employee_id = c.employee_id"""
Q["case_pop"] = """SELECT *, CASE WHEN created_date IS NULL OR effective_target_due_date IS NULL THEN 'Not Eligible' WHEN closed_date IS NULL AND me <= effective_target_due_date THEN 'Pending'
  WHEN closed_date IS NULL OR closed_date > effective_target_due_date THEN 'Breached' ELSE 'Compliant' END AS sla_status FROM case_rows"""
Q["base_er_case_population"] = "SELECT * EXCLUDE (ms, me) FROM case_pop"
Q["base_er_cases_current"] = "SELECT * EXCLUDE (ms, me, aging_days, effective_target_due_date, sla_status) FROM case_pop"
Q["base_er_case_parties"] = f"""SELECT er_case_record_id, case_id, c.employee_id AS subject_employee_id, c.employee_name AS subject_employee_name, subject_classification, owner_id AS owner_employee_id,
  o.employee_name AS owner_employee_name, o.status AS owner_raw_status, {person_class('o.employee_id', 'o.status')} AS owner_classification
FROM case_pop c LEFT JOIN base_employees_deduplicated o ON o.employee_id = c.owner_id"""
Q["base_hr_requests_current"] = """SELECT request_id, r.employee_id, request_type, request_status, created_at, closed_at, owner AS owner_id, sla_hours, actual_hours, sla_breached,
  coalesce(r.project, m.project, 'Unassigned') AS project, coalesce(m.department, 'Unassigned') AS department
FROM hr_requests r JOIN case_m ON CAST(created_at AS DATE) <= e AND (closed_at IS NULL OR CAST(closed_at AS DATE) >= s) LEFT JOIN base_employees_deduplicated m ON m.employee_id = r.employee_id"""
Q["request_clock"] = """SELECT *, CASE WHEN sla_hours IS NULL THEN 'Not Eligible' WHEN actual_hours <= sla_hours THEN 'Compliant' ELSE 'Breached' END AS sla_status FROM base_hr_requests_current"""
Q["base_case_sla_clock"] = """SELECT 'ER' AS source_type, CAST(er_case_record_id AS VARCHAR) AS record_id, effective_target_due_date AS effective_due_date, aging_days, sla_status FROM case_pop
UNION ALL SELECT 'HR_REQ', request_id, CAST(NULL AS DATE), date_diff('day', CAST(created_at AS DATE), coalesce(CAST(closed_at AS DATE), e)), sla_status FROM request_clock, case_m"""
_OPEN = "case_status IN ('Open', 'In Progress', 'Pending')"
_K, _PT = "case_pop", "base_er_case_parties"
Q["mart_er_exceptions"] = issues(texts.CASES, [
    ("Missing Case Owner", _K, f"{_OPEN} AND {BLANK('owner_id')}", "case_id", _NM),
    ("Missing Project", _K, f"{_OPEN} AND project = 'Unassigned'", "case_id", _NM),
    ("Missing Department", _K, f"{_OPEN} AND department = 'Unassigned'", "case_id", _NM),
    ("Missing Case Type", _K, f"{_OPEN} AND {BLANK('case_type')}", "case_id", _NM),
    ("Missing Priority", _K, f"{_OPEN} AND {BLANK('priority')}", "case_id", _NM),
    ("Missing Target Due Date", _K, f"{_OPEN} AND target_due_date IS NULL", "case_id", _NM),
    ("Overdue Open Case", _K, f"{_OPEN} AND me > effective_target_due_date", "case_id", _NM, {"due": "effective_target_due_date"}),
    ("Missing Closure Date", _K, "case_status = 'Closed' AND closed_date IS NULL", "case_id", _NM),
    ("Invalid Date Range", _K, "closed_date < created_date", "case_id", _NM),
    ("Inactive Case Owner", _PT, "owner_classification NOT IN ('Active Employee', 'Unknown Status Employee')", "case_id", "owner_employee_name"),
    ("Inactive Case Subject", _PT, "subject_classification IN ('Inactive Employee', 'Terminated Employee')", "case_id", "subject_employee_name"),
    ("Duplicate Case ID", "(SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM case_pop)", "n > 1", "case_id", _NM),
    ("Missing SLA Status", _K, "sla_status = 'Not Eligible'", "case_id", _NM),
    ("Missing Escalation Reason", _K, f"escalated AND {BLANK('escalation_reason')}", "case_id", _NM),
    ("Missing Legal Reference", _K, f"case_type = 'Labor Case' AND ({BLANK('legal_reference')} OR {BLANK('case_number')})", "case_id", _NM),
])
_CMP, _JDG = "count(*) FILTER (sla_status = 'Compliant')", "count(*) FILTER (sla_status IN ('Compliant', 'Breached'))"
_SLA = PCT(_CMP, _JDG, 100)
Q["mart_er_kpis"] = f"""SELECT count(*) FILTER ({_OPEN}) AS total_open_er_cases, count(*) FILTER (created_date BETWEEN ms AND me) AS new_cases_this_month,
  count(*) FILTER (closed_date BETWEEN ms AND me) AS closed_cases_this_month, coalesce(round(avg(aging_days), 1), 0) AS average_case_aging_days,
  count(*) FILTER ({_OPEN} AND me > effective_target_due_date) AS overdue_cases, {_SLA} AS sla_compliance_pct, count(*) FILTER (case_type = 'Disciplinary') AS disciplinary_cases,
  count(*) FILTER (case_type = 'Grievance') AS grievance_cases, count(*) FILTER (case_type = 'Labor Case') AS labor_cases, count(*) FILTER (escalated) AS escalated_cases,
  (SELECT count(*) FROM mart_er_exceptions) AS er_exception_count FROM case_pop"""
Q["mart_er_case_trend"] = """SELECT period, CAST(sum(n) AS BIGINT) AS new_cases, CAST(sum(c) AS BIGINT) AS closed_cases FROM (
  SELECT strftime(created_date, '%Y-%m') AS period, 1 AS n, 0 AS c FROM employee_relations
  UNION ALL SELECT strftime(closed_date, '%Y-%m'), 0, 1 FROM employee_relations WHERE closed_date IS NOT NULL AND created_date <= last_day(closed_date)), case_m
WHERE period <= label GROUP BY period"""
for _k in ("project", "department"):
    Q[f"mart_er_cases_by_{_k}"] = f"""SELECT {_k}, count(*) AS total_cases, count(*) FILTER ({_OPEN}) AS open_cases, count(*) FILTER (case_status = 'Closed') AS closed_cases,
  count(*) FILTER (escalated) AS escalated_cases, {_CMP} AS compliant_cases, {_SLA} AS compliance_pct FROM case_pop GROUP BY {_k}"""
for _k in ("type", "status"):
    Q[f"mart_er_case_{_k}_distribution"] = f"SELECT case_{_k}, count(*) AS case_count FROM case_pop GROUP BY 1"
Q["mart_er_sla_performance"] = f"""SELECT category_type, category, {_JDG} AS eligible_count, {_CMP} AS compliant_count, count(*) FILTER (sla_status = 'Breached') AS breached_count, {_SLA} AS compliance_pct
FROM (SELECT 'ER' AS category_type, case_type AS category, sla_status FROM case_pop UNION ALL SELECT 'HR_REQ', request_type, sla_status FROM request_clock) GROUP BY 1, 2"""
Q["mart_er_aging_buckets"] = f"""SELECT CASE WHEN aging_days NOT BETWEEN 0 AND 30 OR aging_days IS NULL THEN '30_plus_days' WHEN aging_days > 14 THEN '15_30_days' WHEN aging_days > 7 THEN '8_14_days'
  WHEN aging_days > 3 THEN '4_7_days' ELSE '0_3_days' END AS aging_bucket, count(*) AS case_count FROM case_pop WHERE {_OPEN} GROUP BY 1"""

# ---------------------------------------------------------------- recruitment
Q["reqs"] = "SELECT * RENAME (owner_id AS recruiter_id) FROM recruitment_requisitions"
Q["cands"] = """SELECT candidate_id, candidate_name, CASE WHEN source IN ('LinkedIn', 'Indeed', 'Referral', 'Direct', 'Agency') THEN source ELSE 'Other' END AS source, source AS raw_source,
  pipeline_stage, requisition_id, applied_date FROM candidates"""
Q["ivs"] = "SELECT * RENAME (recruiter_id AS interviewer_id) FROM interviews"
Q["offs"] = "SELECT * RENAME (outcome_status AS offer_status) FROM offers"
Q["onbs"] = "SELECT * RENAME (start_date AS hire_date) FROM onboarding"


def numbered(source: str, name: str, *order: str) -> str:
    keys = ", ".join(f"{c} NULLS LAST" for c in order)
    return f"SELECT row_number() OVER (ORDER BY {keys}) AS {name}, * FROM {source}"


Q["base_requisition_source_records"] = numbered("reqs", "requisition_record_id", "requisition_id", "job_title", "department", "project", "cost_center", "recruiter_id", "approval_date", "status", "target_hire_date", "closed_date")
Q["base_candidate_source_records"] = numbered("cands", "candidate_record_id", "candidate_id", "candidate_name", "requisition_id", "applied_date", "raw_source", "pipeline_stage")
Q["base_interview_source_records"] = numbered("ivs", "interview_record_id", "interview_id", "candidate_id", "interview_date", "interviewer_id", "rating", "outcome")
Q["base_offer_source_records"] = numbered("offs", "offer_record_id", "offer_id", "candidate_id", "offer_date")
Q["base_onboarding_source_records"] = numbered("onbs", "onboarding_record_id", "onboarding_id", "candidate_id", "hire_date")
_ROPEN = "status IN ('Open', 'Approved', 'In Progress', 'On Hold')"
Q["live_reqs"] = "SELECT * FROM reqs WHERE status NOT IN ('Cancelled', 'Rejected', 'Draft')"
Q["base_recruitment_requisitions_current"] = f"""SELECT r.*, coalesce(target_hire_date, approval_date + 45) AS effective_target_hire_date FROM live_reqs r, hire_m
WHERE approval_date <= e AND ({_ROPEN} OR closed_date >= s OR approval_date >= s)"""
Q["base_candidate_canonical"] = """SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY applied_date DESC NULLS LAST, candidate_name DESC NULLS FIRST,
  requisition_id DESC NULLS FIRST, raw_source DESC NULLS FIRST, pipeline_stage DESC NULLS FIRST) = 1"""
Q["base_candidate_pipeline_current"] = """SELECT c.* FROM base_candidate_canonical c JOIN base_recruitment_requisitions_current r USING (requisition_id), hire_m WHERE applied_date <= e"""
Q["chain"] = """SELECT c.candidate_id AS cid, r.approval_date AS ad, r.department AS rd, r.project AS rp FROM base_candidate_canonical c JOIN base_recruitment_requisitions_current r USING (requisition_id)"""
for _n, _s, _d in (("interview", "ivs", "interview_date"), ("offer", "offs", "offer_date")):
    Q[f"base_{_n}_activity_current"] = f"SELECT x.* FROM {_s} x JOIN chain ON cid = x.candidate_id, hire_m WHERE CAST({_d} AS DATE) BETWEEN s AND e"
Q["base_onboarding_current"] = "SELECT x.* FROM onbs x JOIN chain ON cid = x.candidate_id, hire_m WHERE hire_date BETWEEN s AND e"
Q["base_workforce_plan_current"] = "SELECT w.* FROM workforce_plan w, hire_m WHERE period = label"
Q["base_vacancy_population"] = "SELECT v.* FROM vacancy_requests v, hire_m WHERE status = 'Approved' AND approved_date <= e"
Q["plan_actual"] = """SELECT p.*, (SELECT count(*) FROM base_active_workforce w WHERE w.project = p.project AND w.department = p.department) AS actual FROM base_workforce_plan_current p"""
_RC = "base_recruitment_requisitions_current, hire_m"
_RID, _CID, _NULL = "requisition_id", "candidate_id", "NULL"
_PLAN = "coalesce(project, 'Unassigned') || '-' || coalesce(department, 'Unassigned')"
_AP = {"actual": "actual", "planned": "planned_headcount", "target": "e"}
Q["mart_recruitment_exceptions"] = issues(texts.RECRUITMENT, [
    ("Missing Recruiter", _RC, f"{_ROPEN} AND {BLANK('recruiter_id')}", _RID, _NULL),
    ("Missing Project", _RC, f"{_ROPEN} AND coalesce(project, 'Unassigned') = 'Unassigned'", _RID, _NULL),
    ("Missing Department", _RC, f"{_ROPEN} AND coalesce(department, 'Unassigned') = 'Unassigned'", _RID, _NULL),
    ("Missing Cost Center", _RC, f"{_ROPEN} AND {BLANK('cost_center')}", _RID, _NULL),
    ("Missing Job Title", _RC, f"{_ROPEN} AND {BLANK('job_title')}", _RID, _NULL),
    ("Missing Target Hire Date", _RC, f"{_ROPEN} AND target_hire_date IS NULL", _RID, _NULL),
    ("Overdue Requisition", _RC, f"{_ROPEN} AND e > effective_target_hire_date", _RID, _NULL, {"due": "effective_target_hire_date"}),
    ("Empty Candidate Pipeline", _RC, f"{_ROPEN} AND requisition_id NOT IN (SELECT requisition_id FROM base_candidate_pipeline_current)", _RID, _NULL),
    ("Missing Pipeline Stage", "base_candidate_canonical", BLANK("pipeline_stage"), _CID, _NULL),
    ("Unknown Requisition Link", "cands", "requisition_id NOT IN (SELECT requisition_id FROM reqs)", _CID, _NULL),
    ("Missing Interviewer", "ivs", BLANK("interviewer_id"), "interview_id", _NULL),
    ("Missing Interview Date", "ivs", "interview_date IS NULL", "interview_id", _NULL),
    ("Offer Missing Salary", "offs", "salary IS NULL OR salary <= 0", "offer_id", _NULL),
    ("Onboarding Not Triggered", "offs", "offer_status = 'Accepted' AND candidate_id NOT IN (SELECT candidate_id FROM onbs)", "offer_id", _NULL),
    ("Unknown Employee ID", "onbs", "employee_id NOT IN (SELECT employee_id FROM employees)", "onboarding_id", _NULL),
    ("Duplicate Requisition ID", "(SELECT *, count(*) OVER (PARTITION BY requisition_id) AS n FROM reqs)", "n > 1", _RID, _NULL),
    ("Duplicate Candidate ID", "(SELECT *, count(*) OVER (PARTITION BY candidate_id) AS n FROM cands)", "n > 1", _CID, _NULL),
    ("Missing Plan Dimension", "plan_actual", f"{BLANK('project')} OR {BLANK('department')}", "'Plan_Row'", _NULL),
    ("Plan Exceeded", "plan_actual, hire_m", "actual > planned_headcount", _PLAN, _NULL, _AP),
    ("Plan Unfulfilled", "plan_actual, hire_m", "actual < planned_headcount", _PLAN, _NULL, _AP),
    ("Invalid Vacancy Quantity", "base_vacancy_population", "quantity IS NULL OR quantity <= 0", "request_id", _NULL, {"quantity": "coalesce(CAST(quantity AS VARCHAR), 'NULL')"}),
    ("Unknown Source Channel", "cands", "raw_source NOT IN ('LinkedIn', 'Indeed', 'Referral', 'Direct', 'Agency')", _CID, _NULL),
])
_FILL = "CASE WHEN {1} = 0 THEN CASE WHEN {0} = 0 THEN 100 ELSE 0 END ELSE round(CAST({0} AS DOUBLE) * 100 / {1}, 2) END".format
Q["hires"] = "SELECT date_diff('day', ad, hire_date) AS days, rd, rp FROM onbs JOIN chain ON cid = candidate_id WHERE hire_date IS NOT NULL AND ad IS NOT NULL"
Q["mart_recruitment_kpis"] = f"""SELECT (SELECT count(*) FILTER ({_ROPEN}) FROM base_recruitment_requisitions_current) AS open_requisitions,
  (SELECT {WHOLE('quantity')} FROM base_vacancy_population) AS approved_vacancies, (SELECT count(*) FROM base_candidate_pipeline_current) AS candidates_in_pipeline,
  (SELECT count(*) FROM base_interview_activity_current) AS interviews_scheduled, (SELECT count(*) FROM base_offer_activity_current) AS offers_extended,
  (SELECT {PCT("count(*) FILTER (offer_status = 'Accepted')", "count(*) FILTER (offer_status IN ('Accepted', 'Rejected', 'Declined'))", 100)} FROM base_offer_activity_current) AS offer_acceptance_pct,
  (SELECT count(*) FROM base_onboarding_current) AS hires_this_month, (SELECT coalesce(round(avg(days), 1), 0) FROM hires) AS average_time_to_fill,
  (SELECT count(*) FILTER ({_ROPEN} AND e > effective_target_hire_date) FROM base_recruitment_requisitions_current, hire_m) AS overdue_requisitions,
  (SELECT {_FILL('sum(actual)', 'sum(planned_headcount)')} FROM plan_actual) AS workforce_plan_fulfillment_pct,
  (SELECT count(*) FROM mart_recruitment_exceptions) AS recruitment_exception_count"""
Q["mart_recruitment_pipeline"] = "SELECT pipeline_stage, count(*) AS candidate_count FROM base_candidate_pipeline_current GROUP BY 1"
Q["mart_recruitment_trends"] = f"""SELECT period, CAST(sum(o) AS BIGINT) AS requisitions_opened, CAST(sum(h) AS BIGINT) AS hires FROM (
  SELECT strftime(approval_date, '%Y-%m') AS period, count(*) AS o, 0 AS h FROM live_reqs LEFT JOIN base_candidate_canonical c USING (requisition_id) LEFT JOIN onbs USING (candidate_id), hire_m
  WHERE approval_date <= e GROUP BY 1
  UNION ALL SELECT strftime(hire_date, '%Y-%m'), 0, count(*) FROM onbs JOIN base_candidate_canonical c USING (candidate_id) JOIN live_reqs r USING (requisition_id), hire_m
  WHERE hire_date <= e AND approval_date <= last_day(hire_date) AND (r.status IN ('Open', 'Approved', 'In Progress', 'On Hold') OR closed_date >= date_trunc('month', hire_date) OR approval_date >= date_trunc('month', hire_date))
  GROUP BY 1) GROUP BY period"""
for _k in ("project", "department"):
    Q[f"mart_recruitment_by_{_k}"] = f"""SELECT {_k}, count(*) AS total_requisitions, count(*) FILTER ({_ROPEN}) AS open_requisitions, count(*) FILTER (status IN ('Closed', 'Filled')) AS closed_requisitions,
  count(*) FILTER ({_ROPEN} AND effective_target_hire_date < e) AS overdue_requisitions FROM base_recruitment_requisitions_current, hire_m GROUP BY {_k}"""
Q["mart_recruitment_time_to_fill"] = "SELECT rd AS department, rp AS project, coalesce(round(avg(days), 1), 0) AS average_time_to_fill, count(*) AS hire_count FROM hires GROUP BY 1, 2"
Q["mart_recruitment_source_effectiveness"] = """SELECT source, count(*) AS candidate_count, count(*) FILTER (pipeline_stage = 'Hired') AS hire_count,
  round(CAST(count(*) FILTER (pipeline_stage = 'Hired') AS DOUBLE) * 100 / count(*), 2) AS conversion_pct FROM base_candidate_pipeline_current GROUP BY 1"""
Q["mart_offer_acceptance"] = "SELECT offer_status, count(*) AS offer_count FROM base_offer_activity_current GROUP BY 1"
Q["mart_onboarding_status"] = "SELECT status AS onboarding_status, count(*) AS hire_count FROM base_onboarding_current GROUP BY 1"
Q["mart_workforce_plan_vs_actual"] = f"SELECT project, department, planned_headcount, actual AS actual_headcount, {_FILL('actual', 'planned_headcount')} AS fulfillment_pct FROM plan_actual"

# ---------------------------------------------------------------- talent
for _n, (_s, _i, _o) in {
    "performance_review": ("performance_reviews", "performance_review_record_id", ("review_id", "employee_id", "completed_date", "rating", "reviewer_id", "status", "review_period")),
    "performance_goal": ("performance_goals", "performance_goal_record_id", ("goal_id", "employee_id", "due_date")),
    "competency": ("competency_assessments", "competency_assessment_record_id", ("assessment_id", "employee_id", "competency_name", "assessed_date", "required_score", "actual_score")),
    "learning": ("learning_enrollments", "learning_enrollment_record_id", ("enrollment_id", "employee_id", "course_id", "enrollment_date")),
    "succession": ("succession_plans", "succession_plan_record_id", ("plan_id", "critical_role_id", "successor_employee_id")),
    "talent_review": ("talent_reviews", "talent_review_record_id", ("review_id", "employee_id", "performance_rating")),
    "employee_skill": ("employee_skills", "employee_skill_record_id", ("skill_id", "employee_id", "skill_name", "proficiency")),
}.items():
    Q[f"base_{_n}_source_records"] = numbered(_s, _i, *_o)
Q["base_talent_employee_population"] = f"SELECT employee_id, employee_name, department, project, job_title, status FROM base_active_workforce WHERE {FILLED('employee_id')}"
_KNOWN = "employee_id IN (SELECT employee_id FROM base_talent_employee_population)"
_STRANGE = "employee_id NOT IN (SELECT employee_id FROM base_talent_employee_population)"
Q["rated"] = f"""SELECT *, CASE WHEN rating < 1.5 THEN 'Unsatisfactory' WHEN rating < 2.5 THEN 'Needs Improvement' WHEN rating < 3.5 THEN 'Meets Expectations' WHEN rating < 4.5 THEN 'Exceeds Expectations'
  ELSE 'Outstanding' END AS performance_category FROM performance_reviews WHERE status = 'Completed' AND rating BETWEEN 1 AND 5 AND {_KNOWN}
QUALIFY row_number() OVER (PARTITION BY review_period, employee_id ORDER BY completed_date DESC NULLS LAST, review_id DESC NULLS FIRST, rating DESC, reviewer_id DESC NULLS FIRST) = 1"""
Q["base_performance_reviews_current"] = "SELECT r.* FROM rated r, tal_m WHERE review_period = label"
Q["base_performance_goals_current"] = f"SELECT * FROM performance_goals WHERE status IS NOT NULL AND {_KNOWN}"
Q["base_competency_assessments_current"] = f"SELECT * FROM competency_assessments WHERE required_score BETWEEN 1 AND 5 AND actual_score BETWEEN 1 AND 5 AND {_KNOWN}"
Q["base_learning_enrollments_current"] = f"SELECT l.* FROM learning_enrollments l, tal_m WHERE enrollment_date <= e AND {_KNOWN}"
Q["base_training_catalog_current"] = "SELECT * FROM training_catalog"
_CRIT = "('Chief Executive Officer', 'Engineering Director', 'Finance Director', 'HR Manager')"
Q["base_succession_plans_current"] = f"SELECT * FROM succession_plans WHERE is_critical OR role_title IN {_CRIT}"
Q["base_talent_reviews_current"] = f"SELECT * FROM talent_reviews WHERE {_KNOWN} QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY review_id DESC, performance_rating DESC) = 1"
Q["base_employee_skills_current"] = f"SELECT * FROM employee_skills WHERE {_KNOWN}"
Q["base_career_paths_current"] = f"SELECT * FROM career_paths WHERE {_KNOWN}"
_SP, _SUC = "base_succession_plans_current", "successor_employee_id"
_PR, _PG = "performance_reviews", "performance_goals"
Q["mart_talent_exceptions"] = issues(texts.TALENT, [
    ("Missing Performance Review", "base_talent_employee_population, tal_m", "employee_id NOT IN (SELECT employee_id FROM base_performance_reviews_current)", _ID, _NULL, {"month": "label"}),
    ("Review Linked to Unknown Employee", _PR, _STRANGE, _ID, _NULL),
    ("Duplicate Performance Review ID", f"(SELECT *, count(*) OVER (PARTITION BY review_id) AS n FROM {_PR})", "n > 1", "review_id", _NULL),
    ("Review Completed Without Rating", _PR, "status = 'Completed' AND rating IS NULL", "review_id", _NULL),
    ("Rating Outside Allowed Range", _PR, "rating NOT BETWEEN 1 AND 5", "review_id", _NULL, {"rating": one("rating"), "low": "'1.0'", "high": "'5.0'"}),
    ("Review Missing Reviewer", _PR, BLANK("reviewer_id"), "review_id", _NULL),
    ("Goal Linked to Unknown Employee", _PG, _STRANGE, "goal_id", _NULL),
    ("Goal Missing Status", _PG, BLANK("status"), "goal_id", _NULL),
    ("Goal Overdue", f"{_PG}, tal_m", "status NOT IN ('Completed', 'Cancelled') AND due_date < e", "goal_id", _NULL),
    ("Competency Linked to Unknown Employee", "competency_assessments", _STRANGE, "assessment_id", _NULL),
    ("Competency Score Outside Range", "competency_assessments", "required_score NOT BETWEEN 1 AND 5 OR actual_score NOT BETWEEN 1 AND 5", "assessment_id", _NULL,
     {"required": one("required_score"), "actual": one("actual_score")}),
    ("Critical Role Missing Successor", _SP, BLANK(_SUC), "critical_role_id", _NULL),
    ("Successor Linked to Unknown Employee", _SP, f"{FILLED(_SUC)} AND {_SUC} NOT IN (SELECT employee_id FROM base_active_workforce)", _SUC, _NULL),
    ("Successor Assigned to Inactive Employee", f"{_SP} JOIN (SELECT employee_id AS i FROM employees WHERE status <> 'Active') ON i = {_SUC}", "TRUE", _SUC, _NULL),
    ("Successor Readiness Missing", _SP, f"{FILLED(_SUC)} AND {BLANK('readiness')}", "plan_id", _NULL),
    ("Enrollment Linked to Unknown Employee", "learning_enrollments", _STRANGE, "enrollment_id", _NULL),
    ("Training Completed Without Date", "learning_enrollments", "status = 'Completed' AND completion_date IS NULL", "enrollment_id", _NULL),
    ("Training Hours Missing or Invalid", "training_catalog", "coalesce(duration_hours, 0) <= 0", "course_id", _NULL, {"hours": f"coalesce({one('duration_hours')}, 'NULL')"}),
    ("Learning Course Missing Category", "training_catalog", BLANK("category"), "course_id", _NULL),
    ("Talent Review Missing Potential Rating", "talent_reviews", BLANK("potential_rating"), _ID, _NULL),
    ("High Performer With High Flight Risk", "base_performance_reviews_current JOIN base_talent_reviews_current t USING (employee_id)",
     "performance_category IN ('Outstanding', 'Exceeds Expectations') AND flight_risk = 'High'", _ID, _NULL),
    ("Critical Employee Without Successor", "base_talent_employee_population", f"job_title IN {_CRIT} AND NOT EXISTS (SELECT 1 FROM {_SP} WHERE current_employee_id = employee_id AND {FILLED(_SUC)})", _ID, _NULL),
    ("Duplicate Skill Record", "(SELECT *, count(*) OVER (PARTITION BY employee_id, skill_name) AS n FROM employee_skills)", "n > 1", _ID, _NULL),
    ("Career Path Missing Next Role", "career_paths", BLANK("next_role"), _ID, _NULL),
])
_VALID = f"{FILLED(_SUC)} AND {_SUC} IN (SELECT employee_id FROM base_talent_employee_population) AND {FILLED('readiness')}"
_HIGH, _LOW = "performance_category IN ('Outstanding', 'Exceeds Expectations')", "performance_category IN ('Needs Improvement', 'Unsatisfactory')"
Q["learn"] = "SELECT l.*, t.category, t.duration_hours FROM base_learning_enrollments_current l LEFT JOIN training_catalog t USING (course_id)"
_HRS = "round(coalesce(sum(duration_hours) FILTER (status = 'Completed'), 0), 2)"
_DONE, _ELIG = "count(*) FILTER (status = 'Completed')", "count(*) FILTER (status <> 'Cancelled')"
Q["mart_talent_kpis"] = f"""SELECT CAST(rv AS DOUBLE) AS employees_reviewed, {PCT('rv', 'pp', 0)} AS review_completion_pct, ar AS average_performance_rating, CAST(hi AS DOUBLE) AS high_performers,
  CAST(lo AS DOUBLE) AS low_performers, {PCT('gd', 'ge', 0)} AS goal_completion_pct, {PCT('ld', 'le', 0)} AS training_completion_pct,
  CASE WHEN tr = 0 THEN 0 ELSE round(lh / tr, 2) END AS average_training_hours, {PCT('cv', 'ro', 100)} AS critical_roles_covered_pct,
  CAST(rdy AS DOUBLE) AS ready_successors, CAST(ex AS DOUBLE) AS talent_exception_count
FROM (SELECT count(*) AS pp FROM base_talent_employee_population),
  (SELECT count(*) AS rv, round(avg(rating), 2) AS ar, count(*) FILTER ({_HIGH}) AS hi, count(*) FILTER ({_LOW}) AS lo FROM base_performance_reviews_current),
  (SELECT {_DONE} AS gd, {_ELIG} AS ge FROM base_performance_goals_current),
  (SELECT {_DONE} AS ld, {_ELIG} AS le, {_HRS} AS lh, count(DISTINCT employee_id) FILTER (status = 'Completed') AS tr FROM learn),
  (SELECT count(DISTINCT critical_role_id) AS ro FROM {_SP}), (SELECT count(DISTINCT critical_role_id) AS cv FROM {_SP} WHERE {_VALID}),
  (SELECT count(DISTINCT {_SUC}) AS rdy FROM {_SP} WHERE readiness = 'Ready Now' AND {_SUC} IN (SELECT employee_id FROM base_talent_employee_population)),
  (SELECT count(*) AS ex FROM mart_talent_exceptions)"""
Q["mart_performance_distribution"] = "SELECT performance_category, count(*) AS employee_count FROM base_performance_reviews_current GROUP BY 1"
for _k in ("project", "department"):
    Q[f"mart_performance_by_{_k}"] = f"""SELECT e.{_k}, count(*) AS reviewed_count, round(avg(rating), 2) AS average_rating, count(*) FILTER ({_HIGH}) AS high_performers, count(*) FILTER ({_LOW}) AS low_performers
FROM base_performance_reviews_current JOIN base_talent_employee_population e USING (employee_id) GROUP BY 1"""
Q["mart_goal_completion"] = f"""SELECT coalesce(d, 'Unknown') AS department, {_DONE} AS completed_goals, count(*) FILTER (status = 'In Progress') AS in_progress_goals,
  count(*) FILTER (status = 'Overdue') AS overdue_goals, count(*) FILTER (status = 'Not Started') AS not_started_goals, count(*) FILTER (status = 'Cancelled') AS cancelled_goals, {_ELIG} AS eligible_goals
FROM (SELECT g.status, e.department AS d FROM base_performance_goals_current g LEFT JOIN base_talent_employee_population e USING (employee_id)) GROUP BY d"""
Q["mart_competency_gaps"] = """SELECT competency_name, round(avg(required_score), 2) AS avg_required, round(avg(actual_score), 2) AS avg_actual, round(avg(required_score - actual_score), 2) AS avg_gap
FROM base_competency_assessments_current GROUP BY 1"""
Q["mart_learning_completion"] = f"SELECT coalesce(c, 'Uncategorized') AS category, {_DONE} AS completed_enrollments, {_ELIG} AS eligible_enrollments, {_HRS} AS total_hours FROM (SELECT *, category AS c FROM learn) GROUP BY c"
Q["mart_learning_by_project"] = f"""SELECT coalesce(p, 'Unassigned') AS project, coalesce(d, 'Unknown') AS department, {_DONE} AS completed_enrollments, {_HRS} AS total_hours
FROM (SELECT l.*, e.project AS p, e.department AS d FROM learn l LEFT JOIN base_talent_employee_population e USING (employee_id)) GROUP BY p, d"""
Q["mart_succession_coverage"] = f"""SELECT critical_role_id, role_title, n AS valid_successor_count, CASE WHEN n > 0 THEN 'Covered' ELSE 'Not Covered' END AS coverage_status
FROM (SELECT critical_role_id, role_title, count(DISTINCT CASE WHEN ok THEN {_SUC} END) AS n FROM (SELECT *, ({_VALID}) AS ok FROM {_SP}) GROUP BY 1, 2)"""
Q["mart_successor_readiness"] = f"SELECT coalesce(r, 'Missing') AS readiness, count(DISTINCT {_SUC}) AS successor_count FROM (SELECT *, readiness AS r FROM {_SP}) WHERE {FILLED(_SUC)} GROUP BY r"
Q["mart_talent_risk"] = f"""SELECT r.employee_id, coalesce(department, 'Unknown') AS department, coalesce(project, 'Unassigned') AS project, performance_category, coalesce(potential_rating, 'Unknown') AS potential_rating,
  coalesce(flight_risk, 'Unknown') AS flight_risk,
  CASE WHEN flight_risk = 'High' AND ({_HIGH} OR potential_rating = 'High') THEN 'High Risk' WHEN flight_risk = 'High' AND potential_rating IS NOT NULL THEN 'Medium Risk'
    WHEN flight_risk = 'Medium' AND (potential_rating IN ('High', 'Medium') OR NOT {_LOW}) THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_category
FROM base_performance_reviews_current r LEFT JOIN base_talent_reviews_current t USING (employee_id) LEFT JOIN base_talent_employee_population e USING (employee_id)"""
Q["mart_talent_review_trends"] = f"""SELECT period, pp AS total_reviewed, n AS completed_reviews, {PCT('n', 'pp', 0)} AS completion_pct, avg_rating
FROM (SELECT review_period AS period, count(*) AS n, round(avg(rating), 2) AS avg_rating FROM rated GROUP BY 1), (SELECT count(*) AS pp FROM base_talent_employee_population)"""

# ---------------------------------------------------------------- command center
Q["base_command_center_report_context"] = "SELECT label AS report_month, CAST(s AS VARCHAR) AS report_month_start, CAST(e AS VARCHAR) AS report_month_end FROM pay_m"
_FEEDS = {
    "data_quality": ("data-quality", "Data Quality", "data_quality"), "workforce": ("workforce", "Workforce", None), "payroll": ("payroll", "Payroll & Cost", None),
    "attendance": ("attendance", "Attendance", None), "compliance": ("compliance", "Saudization & Compliance", None), "er": ("er", "Employee Relations", None),
    "recruitment": ("recruitment", "Recruitment & Hiring", None), "talent": ("talent", "Talent & Succession", None),
}
for _n, (_key, _label, _src) in _FEEDS.items():
    Q[f"base_command_exception_{_n}"] = (
        f"SELECT '{_key}' AS module_key, '{_label}' AS module_label, 'mart_{_n}_exceptions' AS source_mart, entity_id, entity_name, issue_type, description, severity, recommended_action, "
        f"'/{_key}' AS route_path FROM {_src or 'mart_' + _n + '_exceptions'}"
    )
Q["base_command_center_exception_sources"] = " UNION ALL ".join(f"SELECT * FROM base_command_exception_{_n}" for _n in _FEEDS)
Q["base_command_center_data_freshness"] = " UNION ALL ".join(
    f"SELECT '{m}' AS module_key, '{t}' AS source_table, CAST(max({c}) AS VARCHAR) AS max_source_date FROM {t}"
    for m, t, c in (("payroll", "payroll", "payroll_period"), ("attendance", "attendance", "attendance_date"), ("recruitment", "recruitment_requisitions", "approval_date"),
                    ("talent", "performance_reviews", "completed_date"), ("compliance", "compliance", "period"), ("er", "employee_relations", "coalesce(closed_date, created_date)"),
                    ("workforce", "employees", "joining_date"))
)
_SUMMARY = "max(recommended_action) AS recommended_action"
Q["mart_command_center_exception_summary"] = f"""SELECT module_key, module_label, severity, issue_type, count(*) AS exception_count, {_SUMMARY}, max(route_path) AS route_path
FROM base_command_center_exception_sources GROUP BY 1, 2, 3, 4"""
Q["mart_command_center_priority_alerts"] = f"""SELECT module_key || '_' || issue_type AS alert_id, module_key, module_label, severity, issue_type, count(*) AS issue_count, {_SUMMARY},
  max(source_mart) AS source_mart, max(route_path) AS route_path FROM base_command_center_exception_sources GROUP BY 2, 3, 4, 5"""
Q["mart_command_center_filter_options"] = "SELECT label AS report_month, filter, value FROM pay_m, (" + " UNION ALL ".join(
    [f"SELECT DISTINCT '{f}' AS filter, {c} AS value FROM employees WHERE {c} IS NOT NULL"
     for c, f in (("company", "companies"), ("project", "projects"), ("department", "departments"), ("cost_center", "cost_centers"), ("nationality", "nationalities"))]
    + ["SELECT 'modules', module_key FROM registry"]) + ")"
_MODULES = (("executive", "Executive Summary", "Executive", 8), ("data-quality", "Data Quality", "Data Quality", 7), ("workforce", "Workforce", "Workforce", 5),
            ("payroll", "Payroll & Cost", "Payroll", 5), ("attendance", "Attendance", "Attendance", 5), ("compliance", "Saudization & Compliance", "Compliance", 6),
            ("er", "Employee Relations", "Employee Relations", 6), ("recruitment", "Recruitment & Hiring", "Recruitment", 7), ("talent", "Talent & Succession", "Talent", 11))
Q["registry"] = "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{n}', '/{k}', '{o}', CAST({c} AS INT))" for k, n, o, c in _MODULES) + ") t(module_key, module_label, route_path, owner_domain, primary_kpi_count)"
Q["staleness"] = """SELECT f.*, CASE WHEN max_source_date IS NULL THEN 'No transaction data found in source table'
  WHEN module_key = 'attendance' AND CAST(max_source_date AS DATE) < e THEN 'Attendance date ' || max_source_date || ' is older than expected report month end ' || e
  WHEN module_key IN ('payroll', 'compliance', 'er') AND max_source_date < label THEN
    CASE module_key WHEN 'payroll' THEN 'Payroll' WHEN 'compliance' THEN 'Compliance' ELSE 'ER' END || ' period ' || max_source_date || ' is older than expected report month ' || label
  END AS why FROM base_command_center_data_freshness f, pay_m"""
Q["freshness_rows"] = """SELECT r.module_key, module_label, coalesce(source_table, CASE r.module_key WHEN 'executive' THEN 'mart_exec_kpis' WHEN 'data-quality' THEN 'data_quality' ELSE 'derived' END) AS source_table,
  coalesce(max_source_date, CAST(e AS VARCHAR)) AS max_source_date, CASE WHEN r.module_key = 'executive' THEN (SELECT count(why) > 0 FROM staleness) ELSE why IS NOT NULL END AS stale_flag,
  CASE r.module_key WHEN 'executive' THEN 'Derived from overall system state' WHEN 'data-quality' THEN 'Refreshed during DQ pipeline run' ELSE coalesce(why, 'Data is current') END AS stale_reason
FROM registry r LEFT JOIN staleness f ON f.module_key = r.module_key, pay_m"""
Q["mart_command_center_data_freshness"] = "SELECT * FROM freshness_rows"
_COUNTS = """FROM registry r LEFT JOIN (SELECT module_key, count(*) FILTER (severity = 'Critical') AS c, count(*) FILTER (severity = 'Warning') AS w FROM base_command_center_exception_sources GROUP BY 1) x USING (module_key)
JOIN freshness_rows f USING (module_key)"""
Q["base_command_center_module_status"] = f"""SELECT r.module_key, r.module_label, route_path, owner_domain, 'Healthy' AS api_health_status,
  CASE WHEN k.ok IS NULL THEN 'Unknown' WHEN k.ok THEN 'Passed' ELSE 'Failed' END AS reconciliation_status, TRUE AS required_marts_present,
  stale_flag, coalesce(c, 0) AS critical_exception_count, coalesce(w, 0) AS warning_exception_count, primary_kpi_count {_COUNTS} LEFT JOIN module_passed k USING (module_key)"""
Q["mart_command_center_module_health"] = """SELECT *, CASE WHEN api_health_status = 'Unhealthy' OR NOT required_marts_present OR reconciliation_status = 'Failed' OR critical_exception_count > 0 THEN 'Critical'
  WHEN reconciliation_status = 'Unknown' THEN 'Unknown' WHEN warning_exception_count > 0 OR stale_flag THEN 'Warning' ELSE 'Healthy' END AS status FROM base_command_center_module_status"""
Q["overview"] = """SELECT (SELECT active_headcount FROM mart_workforce_kpis) AS active_headcount, (SELECT total_payroll_cost FROM mart_payroll_kpis) AS payroll_cost,
  (SELECT attendance_compliance_pct FROM mart_attendance_kpis) AS attendance_compliance_pct, (SELECT saudization_pct FROM mart_compliance_kpis) AS saudization_pct,
  (SELECT total_open_er_cases FROM mart_er_kpis) AS open_er_cases, (SELECT open_requisitions FROM mart_recruitment_kpis) AS open_requisitions,
  (SELECT review_completion_pct FROM mart_talent_kpis) AS review_completion_pct, (SELECT count(*) FROM base_command_center_exception_sources) AS total_active_exceptions,
  (SELECT count(*) FILTER (status = 'Healthy') FROM mart_command_center_module_health) AS modules_healthy, (SELECT max(max_source_date) FROM base_command_center_data_freshness) AS latest_source_business_date,
  (SELECT data_quality_score FROM mart_exec_kpis) AS data_quality_score"""
Q["command_center_overview_data"] = "SELECT * FROM overview"
Q["mart_command_center_overview"] = "SELECT * FROM overview"


# ---------------------------------------------------------------- reads
Q["read_payroll_variance"] = "SELECT * FROM mart_payroll_variance_employees ORDER BY abs(change_amount) DESC, employee_id, curr_amount LIMIT 100"


def _status(status, value: str, judged: str | None) -> str:
    v = judged or value
    tests = {">=": "{v} >= {l}", ">": "{v} > {l}", "<": "{v} < {l}", "abs>": "abs({v}) > {l}"}
    steps = " ".join(f"WHEN {tests[c].format(v=v, l=limit)} THEN '{label}'" for c, limit, label in status.steps)
    return f"CASE {steps} ELSE '{status.otherwise}' END" if steps else f"'{status.otherwise}'"


for _module, _source in SUMMARIES.items():
    Q[f"read_{_module}_summary"] = " UNION ALL ".join(
        f"SELECT {quote(k.key)} AS key, {quote(k.label)} AS label, round(CAST(coalesce({k.column or k.key}, 0) AS DOUBLE) * {k.scale}, 2) AS value, {quote(k.unit)} AS unit, "
        f"{_status(k.status, 'coalesce(' + (k.column or k.key) + ', 0)', k.status.judged)} AS status FROM {_source}"
        for k in KPIS[_module]
    )


# ---------------------------------------------------------------- checks
def v(view: str, expr: str, where: str = "TRUE") -> str:
    return f"(SELECT {expr} FROM {view} WHERE {where})"


def _pct(num: str, den: str, zero: int) -> str:
    return f"(CASE WHEN {den} = 0 THEN {zero} ELSE round(CAST({num} AS DOUBLE) * 100 / {den}, 2) END)"


_HC = v("mart_workforce_kpis", "active_headcount")
_SUMS = "sum(saudi_headcount + non_saudi_headcount + employees_missing_nationality)"
_K1, _K2, _K3, _K4 = "mart_payroll_kpis", "mart_attendance_kpis", "mart_compliance_kpis", "mart_er_kpis"
_K5, _K6, _K7 = "mart_recruitment_kpis", "mart_talent_kpis", "overview"
_REV = "base_performance_reviews_current"
_JUDGED = "sla_status IN ('Compliant', 'Breached')"


def _without(issue: str, expr: str) -> str:
    return v(_C, f"round(coalesce(sum({expr}), 0), 2)", f"employee_id NOT IN (SELECT entity_id FROM mart_payroll_exceptions WHERE issue_type = '{issue}')")


# Workdays of active employees from the calendar alone, without the clock records.
_CALENDAR = """(SELECT count(*) FROM (SELECT CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS d FROM att_m) c
  JOIN base_employees_deduplicated m ON m.status = 'Active' AND d BETWEEN m.joining_date AND coalesce(m.termination_date, d) AND dayname(d) <> 'Friday')"""
CHECKS_SQL: dict[str, list[tuple[str, str, str, float]]] = {
    "workforce": [(f"Distribution total: {c}", _HC, v("mart_workforce_distribution", "sum(headcount)", f"category = '{c}'"), 0) for c, _, _ in _DIMENSIONS]
    + [("Contract expiry bucket total", _HC, v("mart_workforce_contract_expiry", 'expired + "0_30" + "31_60" + "61_90" + "90_plus" + missing_date'), 0)],
    "payroll": [
        ("Gross pay equals payroll cost", v(_K1, "total_payroll_cost"), v(_C, MONEY("gross_pay")), 0.01),
        ("Components equal gross pay outside exceptions", "0", _without("Payroll Component Mismatch", f"gross_pay - ({_COMP})"), 0.01),
        ("Net equals gross minus deductions outside exceptions", "0", _without("Net Pay Mismatch", "net_pay - (gross_pay - deductions)"), 0.01),
        ("Project payroll total", v(_K1, "total_payroll_cost"), v("mart_payroll_by_project", MONEY("total_payroll_cost")), 0.01),
        ("Department payroll total", v(_K1, "total_payroll_cost"), v("mart_payroll_by_department", MONEY("total_payroll_cost")), 0.01),
        ("Employees paid", v(_K1, "employees_paid"), v(_C, "count(DISTINCT employee_id)"), 0),
        ("Payroll exception count", v(_K1, "payroll_exception_count"), v("mart_payroll_exceptions", "count(*)"), 0),
    ],
    "attendance": [
        ("Expected workdays", _CALENDAR, v("base_expected_attendance", "count(*)"), 0),
        ("Absence days", v(_K2, "absence_days"), v(_X, "count(*)", "attendance_date IS NULL OR absence_days = 1"), 0.01),
        ("Late minutes", v(_K2, "late_minutes"), v(_R, "sum(calculated_late_minutes)"), 0.01),
        ("Net late minutes", "0", v(_R, "count(*)", "calculated_net_late_minutes <> greatest(calculated_late_minutes - coalesce(excused_late_minutes, 0), 0)"), 0),
        ("Missing punches", v(_K2, "missing_punch_count"), v("mart_attendance_exceptions", "count(*)", "issue_type IN ('Missing Check-in', 'Missing Check-out')"), 0),
        ("Approved overtime hours", v(_K2, "overtime_hours"), v(_O, "sum(attendance_ot_hours)"), 0.01),
        ("Payroll overtime cost", v(_K2, "overtime_cost"), v(_O, MONEY("payroll_ot_cost")), 0.01),
        ("Attendance exception count", v(_K2, "attendance_exception_count"), v("mart_attendance_exceptions", "count(*)"), 0),
    ],
    "compliance": [
        ("Nationality groups cover active headcount", _HC, v(_K3, "saudi_headcount + non_saudi_headcount + employees_missing_nationality"), 0),
        ("Saudization %", v(_K3, "saudization_pct"), v(_K3, "round(100.0 * saudi_headcount / (saudi_headcount + non_saudi_headcount), 2)"), 0.01),
        ("Project headcount total", _HC, v("mart_saudization_by_project", _SUMS), 0),
        ("Department headcount total", _HC, v("mart_saudization_by_department", _SUMS), 0),
        ("Iqama bucket total", v(_K3, "non_saudi_headcount"), v("mart_document_expiry", "sum(iqama_count)"), 0),
        ("Work permit bucket total", v(_K3, "non_saudi_headcount"), v("mart_document_expiry", "sum(work_permit_count)"), 0),
        ("GOSI status total", _HC, v("mart_gosi_status", "sum(employee_count)"), 0),
        ("WPS status total", _HC, v("mart_wps_status", "sum(headcount)"), 0),
        ("Compliance exception count", v(_K3, "compliance_exception_count"), v("mart_compliance_exceptions", "count(*)"), 0),
    ],
    "cases": [
        ("Total open cases", v(_K4, "total_open_er_cases"), v(_K, "count(*)", _OPEN), 0),
        ("Closed cases this month", v(_K4, "closed_cases_this_month"), v(_K, "count(*)", "closed_date BETWEEN ms AND me"), 0),
        ("New cases this month", v(_K4, "new_cases_this_month"), v(_K, "count(*)", "created_date BETWEEN ms AND me"), 0),
        ("Case type total", v(_K, "count(*)"), v("mart_er_case_type_distribution", "sum(case_count)"), 0),
        ("Case status total", v(_K, "count(*)"), v("mart_er_case_status_distribution", "sum(case_count)"), 0),
        ("Project case total", v(_K, "count(*)"), v("mart_er_cases_by_project", "sum(total_cases)"), 0),
        ("Department case total", v(_K, "count(*)"), v("mart_er_cases_by_department", "sum(total_cases)"), 0),
        ("SLA compliance %", v(_K4, "sla_compliance_pct"), _pct(v(_K, "count(*)", "sla_status = 'Compliant'"), v(_K, "count(*)", _JUDGED), 100), 0.01),
        ("Overdue cases", v(_K4, "overdue_cases"), v(_K, "count(*)", f"{_OPEN} AND effective_target_due_date < me"), 0),
        ("Case exception count", v(_K4, "er_exception_count"), v("mart_er_exceptions", "count(*)"), 0),
        ("Aging bucket total", v(_K4, "total_open_er_cases"), v("mart_er_aging_buckets", "sum(case_count)"), 0),
    ],
    "recruitment": [
        ("Open requisitions", v(_K5, "open_requisitions"), v("base_recruitment_requisitions_current", "count(*)", _ROPEN), 0),
        ("Approved vacancies", v(_K5, "approved_vacancies"), v("base_vacancy_population", "coalesce(sum(quantity), 0)"), 0),
        ("Candidates in pipeline", v(_K5, "candidates_in_pipeline"), v("base_candidate_pipeline_current", "count(*)"), 0),
        ("Interviews scheduled", v(_K5, "interviews_scheduled"), v("base_interview_activity_current", "count(*)"), 0),
        ("Offers extended", v(_K5, "offers_extended"), v("base_offer_activity_current", "count(*)"), 0),
        ("Offer acceptance %", v(_K5, "offer_acceptance_pct"), _pct(v("base_offer_activity_current", "count(*)", "offer_status = 'Accepted'"),
            v("base_offer_activity_current", "count(*)", "offer_status IN ('Accepted', 'Rejected', 'Declined')"), 100), 0.01),
        ("Hires this month", v(_K5, "hires_this_month"), v("base_onboarding_current", "count(*)"), 0),
        ("Average time to fill", v(_K5, "average_time_to_fill"), v("hires", "coalesce(round(avg(days), 1), 0)"), 0.01),
        ("Overdue requisitions", v(_K5, "overdue_requisitions"), v("base_recruitment_requisitions_current, hire_m", "count(*)", f"{_ROPEN} AND effective_target_hire_date < e"), 0),
        ("Workforce plan fulfillment %", v(_K5, "workforce_plan_fulfillment_pct"), _pct(v("base_workforce_plan_current p JOIN base_active_workforce w ON p.project = w.project AND p.department = w.department", "count(*)"),
            v("base_workforce_plan_current", "sum(planned_headcount)"), 0), 0.01),
        ("Project requisition total", v("base_recruitment_requisitions_current", "count(*)"), v("mart_recruitment_by_project", "sum(total_requisitions)"), 0),
        ("Department requisition total", v("base_recruitment_requisitions_current", "count(*)"), v("mart_recruitment_by_department", "sum(total_requisitions)"), 0),
        ("Recruitment exception count", v(_K5, "recruitment_exception_count"), v("mart_recruitment_exceptions", "count(*)"), 0),
    ],
    "talent": [
        ("Employees reviewed", v(_K6, "employees_reviewed"), v(_REV, "count(DISTINCT employee_id)"), 0),
        ("Review completion %", v(_K6, "review_completion_pct"), _pct(v(_REV, "count(DISTINCT employee_id)"), v("base_talent_employee_population", "count(*)"), 0), 0.1),
        ("Average performance rating", v(_K6, "average_performance_rating"), v(_REV, "round(sum(rating) / count(rating), 2)"), 0.01),
        ("Performance distribution total", v(_REV, "count(*)"), v("mart_performance_distribution", "sum(employee_count)"), 0),
        ("High performers", v(_K6, "high_performers"), v(_REV, "count(DISTINCT employee_id)", _HIGH), 0),
        ("Low performers", v(_K6, "low_performers"), v(_REV, "count(DISTINCT employee_id)", _LOW), 0),
        ("Goal completion %", v(_K6, "goal_completion_pct"), v("base_performance_goals_current", _pct(_DONE, _ELIG, 0)), 0.1),
        ("Training completion %", v(_K6, "training_completion_pct"), v("base_learning_enrollments_current", _pct(_DONE, _ELIG, 0)), 0.1),
        ("Average training hours", v(_K6, "average_training_hours"), v("learn", "round(round(sum(duration_hours), 2) / count(DISTINCT employee_id), 2)", "status = 'Completed'"), 0.1),
        ("Critical roles covered %", v(_K6, "critical_roles_covered_pct"), _pct(v(_SP, "count(DISTINCT critical_role_id)", _VALID), v(_SP, "count(DISTINCT critical_role_id)"), 100), 0.1),
        ("Ready successors", v(_K6, "ready_successors"), v(_SP, f"count(DISTINCT {_SUC})", f"readiness = 'Ready Now' AND {_SUC} IN (SELECT employee_id FROM base_talent_employee_population)"), 0),
        ("Reviewed by project total", v(_REV, "count(*)"), v("mart_performance_by_project", "sum(reviewed_count)"), 0),
        ("Talent exception count", v(_K6, "talent_exception_count"), v("mart_talent_exceptions", "count(*)"), 0),
    ],
    "command_center": [
        ("Overview active headcount", _HC, v(_K7, "active_headcount"), 0),
        ("Overview payroll cost", v(_K1, "total_payroll_cost"), v(_K7, "payroll_cost"), 0.01),
        ("Overview attendance compliance", v(_K2, "attendance_compliance_pct"), v(_K7, "attendance_compliance_pct"), 0.001),
        ("Overview saudization %", v(_K3, "saudization_pct"), v(_K7, "saudization_pct"), 0.001),
        ("Overview open cases", v(_K4, "total_open_er_cases"), v(_K7, "open_er_cases"), 0),
        ("Overview open requisitions", v(_K5, "open_requisitions"), v(_K7, "open_requisitions"), 0),
        ("Overview review completion %", v(_K6, "review_completion_pct"), v(_K7, "review_completion_pct"), 0.001),
        ("Overview total exceptions", v("base_command_center_exception_sources", "count(*)"), v(_K7, "total_active_exceptions"), 0),
        ("Module registry count", "9", v("registry", "count(*)"), 0),
        ("Data freshness rows", "9", v("freshness_rows", "count(*)"), 0),
    ],
}
for _domain, _list in CHECKS_SQL.items():
    Q[f"checks_{_domain}"] = (
        "SELECT check_name, expected, actual, round(abs(expected - actual), 6) AS difference, tolerance, abs(expected - actual) <= tolerance + 0.000000001 AS passed FROM ("
        + " UNION ALL ".join(
            f"SELECT {quote(n)} AS check_name, CAST({e} AS DOUBLE) AS expected, CAST({a} AS DOUBLE) AS actual, CAST({t} AS DOUBLE) AS tolerance" for n, e, a, t in _list
        )
        + ")"
    )


Q["module_passed"] = " UNION ALL ".join(
    f"SELECT '{ {'cases': 'er'}.get(d, d) }' AS module_key, bool_and(coalesce(passed, expected IS NULL AND actual IS NULL)) AS ok FROM checks_{d}"
    for d in CHECKS_SQL
    if d != "command_center"
)
_HEADCOUNT_FIELDS = "company, department, project, job_title, job_family, grade, manager_id, cost_center, nationality, is_saudi, basic_salary, contract_type, contract_end_date"
Q["fact_headcount_snapshot"] = f"""SELECT strftime(m, '%Y-%m') AS snapshot_month, employee_id, CASE WHEN termination_date <= last_day(m) THEN 'Terminated' WHEN status = 'Terminated' THEN 'Active' ELSE status END AS status, {_HEADCOUNT_FIELDS}
FROM (SELECT d.*, CAST(unnest(generate_series(date_trunc('month', joining_date), date_trunc('month', least(e, coalesce(termination_date, e))), INTERVAL 1 MONTH)) AS DATE) AS m
  FROM base_employees_deduplicated d, pay_m WHERE joining_date IS NOT NULL) x"""


def statement(name: str) -> str:
    """The query with everything it refers to as common table expressions in front."""
    ordered: list[str] = []

    def visit(query: str, inside: tuple[str, ...] = ()) -> None:
        for word in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'[^']*'", "", QUERIES[query]))):
            if word in QUERIES and word != query and word not in inside and word not in ordered:
                visit(word, inside + (query,))
        if query not in ordered:
            ordered.append(query)

    visit(name)
    return "WITH " + ",\n".join(f"{q} AS ({QUERIES[q]})" for q in ordered) + f"\nSELECT * FROM {name}"
