"""Batch data-quality validators over the typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_empty, money_text
from tallyhouse.operators.rules import flag_rows, stack
from tallyhouse.plans.texts import VALIDATION
from tallyhouse.plans.warehouse import Warehouse, rule_from, view


@view("data_quality")
def data_quality(wh: Warehouse) -> DataFrame:
    """Issue rows of eleven validators; names come from one join with the deduplicated master."""

    def rule(issue, when, **slots):
        return rule_from(VALIDATION, issue, when, **slots)

    employees = wh.table("employees")
    active = F.col("status") == "Active"
    # A row for each name that a repeated id goes by; names are never gathered, however many there are.
    by_name = employees.groupBy("employee_id", "employee_name").agg(F.count(F.lit(1)).alias("n"))
    copies = by_name.groupBy(F.col("employee_id").alias("_id")).agg(F.sum("n").alias("copies")).where("copies > 1")
    repeated = by_name.join(copies, F.col("employee_id").eqNullSafe(F.col("_id")))
    master = wh.view("base_employees_deduplicated").select("employee_id", "employee_name", "status")
    payroll = wh.table("payroll").select("employee_id", "payroll_period", "gross_pay", "net_pay", "basic_salary")
    punches = wh.table("attendance").where("missing_punch_count > 0").select("employee_id", "attendance_date")
    late = wh.table("hr_requests").where("sla_breached").select("employee_id", "request_id", "request_type", "actual_hours", "sla_hours")
    known = F.coalesce("employee_name", F.lit("Unknown"))
    return stack(
        flag_rows(repeated, [rule("Duplicate Employee ID", F.lit(True))], "employee_id", "employee_name"),
        flag_rows(
            employees,
            [
                rule("Missing Manager", active & is_empty("manager_id")),
                rule("Missing Project", active & is_empty("project")),
                rule("Missing Nationality", is_empty("nationality")),
                rule("Missing Cost Center", is_empty("cost_center")),
                rule("Active Employee with Missing Salary", active & (F.col("basic_salary").isNull() | (F.col("basic_salary") == 0))),
                rule("Abnormal Payroll Value", active & (F.col("basic_salary") < 0), basic=money_text("basic_salary")),
            ],
            "employee_id",
            "employee_name",
        ),
        flag_rows(
            payroll.join(master, "employee_id", "left"),
            [
                rule(
                    "Inactive Employee with Payroll Record",
                    F.col("status").isNull() | F.col("status").isin("Terminated", "Inactive"),
                    status=F.coalesce("status", F.lit("None")),
                    entity_name=F.coalesce("employee_name", F.lit("Unknown Employee")),
                ),
                rule(
                    "Negative or Abnormal Payroll Value",
                    (F.col("gross_pay") < 0) | (F.col("net_pay") < 0) | (F.col("basic_salary") < 0),
                    gross=money_text("gross_pay"),
                    net=money_text("net_pay"),
                ),
            ],
            "employee_id",
            known,
        ),
        flag_rows(
            punches.join(master, "employee_id", "left"),
            [rule("Attendance Record with Missing Punch", F.lit(True), day="attendance_date")],
            "employee_id",
            known,
        ),
        flag_rows(
            late.join(master, "employee_id", "left"),
            [rule("HR Request Breaching SLA", F.lit(True), actual="actual_hours", sla=F.coalesce(F.col("sla_hours").cast("string"), F.lit("None")))],
            "employee_id",
            known,
        ),
    )
