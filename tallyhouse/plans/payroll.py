"""Payroll views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_empty, money_text, ratio, total
from tallyhouse.operators.relational import measures_to_rows, side_by_side
from tallyhouse.operators.rules import flag_rows, stack
from tallyhouse.operators.temporal import change
from tallyhouse.plans.params import Month
from tallyhouse.plans.texts import PAYROLL
from tallyhouse.plans.warehouse import Warehouse, rule_from, view

COMPONENTS = ("basic_salary", "housing_allowance", "transport_allowance", "other_allowances", "overtime_amount")

# Component labels in report order (fixed values).
COMPONENT_LABELS = {
    "basic_salary": "Basic Salary",
    "housing_allowance": "Housing Allowance",
    "transport_allowance": "Transport Allowance",
    "other_allowances": "Other Allowances",
    "overtime_amount": "Overtime",
    "deductions": "Deductions",
}


def _components():
    return sum((F.col(c) for c in COMPONENTS[1:]), F.col(COMPONENTS[0]))


def _allowances():
    return F.col("housing_allowance") + F.col("transport_allowance") + F.col("other_allowances")


def _period(wh: Warehouse, month: Month) -> DataFrame:
    """Payroll rows of a month with the attributes of active employees; others get default labels."""
    people = wh.view("base_active_workforce").select(
        "employee_id",
        F.col("project").alias("_project"),
        F.col("department").alias("_department"),
        F.col("cost_center").alias("_cost_center"),
        F.col("status").alias("_status"),
        "employee_name",
        "is_saudi",
    )
    rows = wh.table("payroll").where(F.col("payroll_period") == month.label)
    return rows.join(people, "employee_id", "left").select(
        *rows.columns,
        F.coalesce("_project", F.lit("Missing Project")).alias("emp_project"),
        F.coalesce("_department", F.lit("Missing Department")).alias("emp_department"),
        F.coalesce("_cost_center", F.lit("Missing Cost Center")).alias("emp_cost_center"),
        F.coalesce("_status", F.lit("Inactive/Terminated/Unknown")).alias("emp_status"),
        "employee_name",
        "is_saudi",
    )


@view("base_payroll_current")
def payroll_current(wh: Warehouse) -> DataFrame:
    return _period(wh, wh.payroll_month)


@view("base_payroll_previous")
def payroll_previous(wh: Warehouse) -> DataFrame:
    return _period(wh, wh.payroll_month.back(1))


def _pay_by_employee(wh: Warehouse) -> DataFrame:
    """Total pay of the month and of the month before, one row per employee paid in the month.

    Both months are collapsed before they are compared, so several lines of one
    employee are neither paired with each other nor held against a total.
    """
    def totals(rows: DataFrame, prefix: str, *more) -> DataFrame:
        return rows.groupBy("employee_id").agg(
            F.round(F.sum("gross_pay"), 2).alias(f"{prefix}_gross"), F.round(F.sum("basic_salary"), 2).alias(f"{prefix}_basic"), *more
        )

    earlier = wh.table("payroll").where(F.col("payroll_period") == wh.payroll_month.back(1).label)
    now = totals(wh.view("base_payroll_current"), "curr", F.max("employee_name").alias("employee_name"))
    return now.join(totals(earlier, "prev"), "employee_id", "left")


@view("mart_payroll_exceptions")
def payroll_exceptions(wh: Warehouse) -> DataFrame:
    month = wh.payroll_month

    def rule(issue, when, **slots):
        return rule_from(PAYROLL, issue, when, **slots)

    gross, net = money_text("gross_pay"), money_text("net_pay")
    current = wh.view("base_payroll_current")
    hours = (
        wh.table("attendance")
        .where(F.col("attendance_date").between(F.lit(month.start), F.lit(month.end)))
        .groupBy("employee_id")
        .agg(F.sum("overtime_hours").alias("ot_hours"))
    )
    rows = current.join(hours, "employee_id", "left")
    gross_change = F.col("curr_gross") - F.col("prev_gross")
    basic_share = F.abs(F.col("curr_basic") - F.col("prev_basic")) / F.nullif(F.col("prev_basic"), F.lit(0.0))
    large = (F.abs(gross_change) > wh.rules.variance_amount) | (
        (F.col("prev_basic") > 0) & (basic_share > wh.rules.variance_share)
    )
    repeated = (
        current.groupBy("employee_id", "payroll_period", "employee_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    paid = current.select(F.col("employee_id").alias("_paid")).distinct()
    unpaid = wh.view("base_active_workforce").join(paid, F.col("employee_id") == F.col("_paid"), "left_anti")
    return stack(
        flag_rows(
            rows,
            [
                rule(
                    "Inactive Employee Payroll",
                    F.col("emp_status") == "Inactive/Terminated/Unknown",
                    entity_name=F.coalesce("employee_name", F.lit("Unknown Employee")),
                ),
                rule("Negative Gross Pay", F.col("gross_pay") < 0, gross=gross),
                rule("Negative Net Pay", F.col("net_pay") < 0, net=net),
                rule("Net Pay Exceeds Gross Pay", F.col("net_pay") > F.col("gross_pay"), net=net, gross=gross),
                rule("Missing Cost Center", is_empty("cost_center") | (F.col("emp_cost_center") == "Missing Cost Center")),
                rule("Missing Project", is_empty("project") | (F.col("emp_project") == "Missing Project")),
                rule(
                    "Overtime Cost Without Hours",
                    (F.col("overtime_amount") > 0) & (F.coalesce("ot_hours", F.lit(0.0)) == 0),
                    overtime=money_text("overtime_amount"),
                ),
                rule(
                    "Payroll Component Mismatch",
                    F.abs(F.col("gross_pay") - _components()) > 0.01,
                    gross=gross,
                    components=money_text(_components()),
                ),
                rule(
                    "Net Pay Mismatch",
                    F.abs(F.col("net_pay") - (F.col("gross_pay") - F.col("deductions"))) > 0.01,
                    net=net,
                    expected_net=money_text(F.col("gross_pay") - F.col("deductions")),
                ),
            ],
            "employee_id",
            "employee_name",
        ),
        flag_rows(
            _pay_by_employee(wh),
            [rule("Large Payroll Variance", large, change=money_text(gross_change), basic_pct=money_text(basic_share * 100))],
            "employee_id",
            "employee_name",
        ),
        flag_rows(unpaid, [rule("Active Employee Missing Payroll", F.lit(True))], "employee_id", "employee_name"),
        flag_rows(
            repeated,
            [rule("Duplicate Payroll Record", F.lit(True))],
            "employee_id",
            F.coalesce("employee_name", F.lit("Unknown Employee")),
        ),
    )


def _month_sums(df: DataFrame) -> DataFrame:
    return df.agg(*[total(c).alias(c) for c in COMPONENT_LABELS], total("gross_pay").alias("gross_pay"))


@view("mart_payroll_kpis")
def payroll_kpis(wh: Warehouse) -> DataFrame:
    wh.settle("base_payroll_current")  # read by the KPI row and by the rules
    current = wh.view("base_payroll_current").agg(
        total("gross_pay").alias("total_payroll_cost"),
        total("basic_salary").alias("basic_salary_cost"),
        total(_allowances()).alias("allowances_cost"),
        total("overtime_amount").alias("overtime_cost"),
        total("deductions").alias("deductions"),
        total("net_pay").alias("net_payroll"),
        F.count_distinct("employee_id").alias("employees_paid"),
    )
    previous = (
        wh.table("payroll")
        .where(F.col("payroll_period") == wh.payroll_month.back(1).label)
        .agg(total("gross_pay").alias("previous_cost"))
    )
    issues = wh.number_of_issues("mart_payroll_exceptions", "payroll_exception_count")
    _, share = change(F.col("total_payroll_cost"), F.col("previous_cost"))
    return side_by_side(current, previous, issues).select(
        "total_payroll_cost",
        "basic_salary_cost",
        "allowances_cost",
        "overtime_cost",
        "deductions",
        "net_payroll",
        ratio("total_payroll_cost", "employees_paid").alias("avg_cost_per_employee"),
        share.alias("payroll_variance_pct"),
        "employees_paid",
        "payroll_exception_count",
    )


@view("mart_payroll_trend")
def payroll_trend(wh: Warehouse) -> DataFrame:
    return (
        wh.table("payroll")
        .groupBy(F.col("payroll_period").alias("month"))
        .agg(
            total("gross_pay").alias("total_payroll_cost"),
            total("basic_salary").alias("basic_salary"),
            total(_allowances()).alias("allowances"),
            total("overtime_amount").alias("overtime"),
            total("deductions").alias("deductions"),
            total("net_pay").alias("net_payroll"),
            F.count_distinct("employee_id").alias("headcount"),
        )
        .orderBy("month")
    )


def _cost_by(wh: Warehouse, key: str) -> DataFrame:
    return wh.view("base_payroll_current").groupBy(key).agg(
        F.count_distinct("employee_id").alias("headcount"),
        total("gross_pay").alias("total_payroll_cost"),
        total("overtime_amount").alias("overtime_cost"),
    )


@view("mart_payroll_by_project")
def payroll_by_project(wh: Warehouse) -> DataFrame:
    """By the project on the payroll row, not the employee's project."""
    return _cost_by(wh, "project").withColumn("project", F.coalesce("project", F.lit("Missing Project")))


@view("mart_payroll_by_department")
def payroll_by_department(wh: Warehouse) -> DataFrame:
    return _cost_by(wh, "emp_department").withColumnRenamed("emp_department", "department")


@view("mart_payroll_components")
def payroll_components(wh: Warehouse) -> DataFrame:
    row = _month_sums(wh.view("base_payroll_current"))
    row = row.withColumn("remainder", F.round(F.col("gross_pay") - _components(), 2))
    return measures_to_rows(row, {**COMPONENT_LABELS, "remainder": "Unreconciled / Exception Amount"}, "component", "amount")


@view("mart_payroll_variance_components")
def payroll_variance_components(wh: Warehouse) -> DataFrame:
    """Both months from one scan: each measure is summed per period, then turned into rows."""
    now, before = wh.payroll_month.label, wh.payroll_month.back(1).label
    rows = wh.table("payroll").where(F.col("payroll_period").isin(now, before))
    sums = rows.agg(
        *[total(F.when(F.col("payroll_period") == before, F.col(c))).alias(f"{c}_prev") for c in COMPONENT_LABELS],
        *[total(F.when(F.col("payroll_period") == now, F.col(c))).alias(f"{c}_curr") for c in COMPONENT_LABELS],
    )
    entries = [
        F.struct(F.lit(label).alias("component"), F.col(f"{c}_prev").alias("prev_amount"), F.col(f"{c}_curr").alias("curr_amount"))
        for c, label in COMPONENT_LABELS.items()
    ]
    amount, share = change(F.col("curr_amount"), F.col("prev_amount"))
    return sums.select(F.inline(F.array(*entries))).select(
        "component", "prev_amount", "curr_amount", F.round(amount, 2).alias("change_amount"), F.round(share, 6).alias("change_pct")
    )


@view("mart_payroll_variance_employees")
def payroll_variance_employees(wh: Warehouse) -> DataFrame:
    """One row per paid employee: the month's total against the total of the month before."""
    amount, share = change(F.col("curr_gross"), F.col("prev_gross"))
    return _pay_by_employee(wh).select(
        "employee_id",
        "employee_name",
        F.coalesce("prev_gross", F.lit(0.0)).alias("prev_amount"),
        F.col("curr_gross").alias("curr_amount"),
        F.round(amount, 2).alias("change_amount"),
        F.round(share, 6).alias("change_pct"),
    )


@view("mart_payroll_reconciliation")
def payroll_reconciliation(wh: Warehouse) -> DataFrame:
    wh.settle("base_payroll_current")
    totals = wh.view("base_payroll_current").agg(
        total("gross_pay").alias("total_gross_payroll"),
        total("basic_salary").alias("basic_salary_sum"),
        total("housing_allowance").alias("housing_allowance_sum"),
        total("transport_allowance").alias("transport_allowance_sum"),
        total("other_allowances").alias("other_allowances_sum"),
        total("overtime_amount").alias("overtime_sum"),
        total("deductions").alias("deductions_sum"),
        total("net_pay").alias("net_payroll"),
        F.count_distinct("employee_id").alias("employees_paid_count"),
    )
    projects = wh.view("mart_payroll_by_project").agg(total("total_payroll_cost").alias("project_payroll_total"))
    departments = wh.view("mart_payroll_by_department").agg(total("total_payroll_cost").alias("department_payroll_total"))
    issues = wh.number_of_issues("mart_payroll_exceptions", "payroll_exception_count")
    shown = F.round(
        F.col("basic_salary_sum") + F.col("housing_allowance_sum") + F.col("transport_allowance_sum")
        + F.col("other_allowances_sum") + F.col("overtime_sum"),
        2,
    )
    after = F.round(F.col("total_gross_payroll") - F.col("deductions_sum"), 2)
    row = side_by_side(totals, projects, departments, issues)
    return row.select(
        *totals.columns,
        shown.alias("sum_displayed_components"),
        F.round(F.col("total_gross_payroll") - shown, 2).alias("unreconciled_component_difference"),
        after.alias("gross_minus_deductions"),
        F.round(after - F.col("net_payroll"), 2).alias("net_unreconciled_difference"),
        "project_payroll_total",
        "department_payroll_total",
        "payroll_exception_count",
    )
