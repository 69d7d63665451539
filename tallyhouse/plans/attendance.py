"""Attendance views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import floor_zero, minute_boundaries, money_text, tally, total, whole
from tallyhouse.operators.reconcile import presence_status
from tallyhouse.operators.relational import add_group_total, full_join_unique, side_by_side
from tallyhouse.operators.rules import flag_rows, is_counting, stack
from tallyhouse.operators.temporal import expand_days, late_minutes, working_days
from tallyhouse.plans.texts import ATTENDANCE
from tallyhouse.plans.warehouse import Warehouse, rule_from, view


def _attendance(wh: Warehouse, first: date, last: date) -> DataFrame:
    """Clock records of a date range with employee attributes and recomputed lateness."""
    people = wh.view("base_employees_deduplicated").select(
        F.col("employee_id").alias("_id"),
        F.col("employee_name").alias("emp_name"),
        F.col("status").alias("emp_status"),
        F.col("department").alias("emp_department"),
        F.col("project").alias("emp_project"),
        F.col("joining_date").alias("emp_joining_date"),
        F.col("termination_date").alias("emp_termination_date"),
    )
    rows = wh.table("attendance").where(F.col("attendance_date").between(F.lit(first), F.lit(last)))
    late = late_minutes("scheduled_start", "actual_check_in", wh.rules.grace_minutes)
    kind = (
        F.when(F.col("_id").isNull(), "Unknown employee attendance")
        .when(F.col("emp_status").isin("Active", "Inactive", "Terminated"), F.concat("emp_status", F.lit(" employee attendance")))
        .otherwise("Other employee attendance")
    )
    return (
        rows.join(people, F.col("employee_id") == F.col("_id"), "left")
        .withColumn("calculated_late_minutes", late)
        .withColumn(
            "calculated_net_late_minutes",
            floor_zero(F.col("calculated_late_minutes") - F.coalesce("excused_late_minutes", F.lit(0).cast("bigint"))),
        )
        .withColumn("record_classification", kind)
        .drop("_id")
    )


def _working(wh: Warehouse, first: date, last: date) -> DataFrame:
    """Active employees with the first and last day of the range on which they are expected."""
    people = wh.view("base_employees_deduplicated").where("status = 'Active' AND joining_date IS NOT NULL").select(
        "employee_id", "employee_name", "department", "project", "status", "joining_date", "termination_date"
    )
    return people.withColumns(
        {"_first": F.greatest(F.lit(first), F.col("joining_date")), "_last": F.least(F.lit(last), F.col("termination_date"))}
    )


def _records(wh: Warehouse, first: date, last: date) -> DataFrame:
    return _attendance(wh, first, last).select(
        F.col("employee_id").alias("_id"),
        "attendance_date",
        "scheduled_start",
        "scheduled_end",
        "actual_check_in",
        "actual_check_out",
        "calculated_late_minutes",
        "calculated_net_late_minutes",
        "excused_late_minutes",
        "missing_punch_count",
        "overtime_hours",
        "overtime_approved",
        F.col("absence_days").alias("_absence"),
    )


def _expected(wh: Warehouse, first: date, last: date) -> DataFrame:
    """Each active employee on each working day of the range, with the clock record if there is one.

    A day without a record counts as one absence day.
    """
    people = _working(wh, first, last)
    days = expand_days(people, F.col("_first"), F.col("_last"), "calendar_date", wh.rules.weekend_days)
    records = _records(wh, first, last)
    match = (F.col("employee_id") == F.col("_id")) & (F.col("calendar_date") == F.col("attendance_date"))
    absence = F.when(F.col("_id").isNull(), 1.0).otherwise(F.coalesce("_absence", F.lit(0.0)))
    return days.join(records, match, "left").select(
        "calendar_date",
        *[c for c in people.columns if not c.startswith("_")],
        *[c for c in records.columns if not c.startswith("_")],
        absence.alias("absence_days"),
    )


def _matched(wh: Warehouse, first: date, last: date) -> DataFrame:
    """The expected days that have a clock record: the records themselves decide, no day is generated."""
    people, records = _working(wh, first, last), _records(wh, first, last)
    day = F.col("attendance_date")
    expected = (F.col("employee_id") == F.col("_id")) & day.between(F.col("_first"), F.col("_last"))
    workday = ~F.date_format(day, "EEEE").isin(list(wh.rules.weekend_days))
    return records.where(workday).join(people, expected).select(
        day.alias("calendar_date"),
        *[c for c in people.columns if not c.startswith("_")],
        *[c for c in records.columns if not c.startswith("_")],
        F.coalesce("_absence", F.lit(0.0)).alias("absence_days"),
    )


def _month_matched(wh: Warehouse) -> DataFrame:
    return wh.stored("attendance records on workdays", lambda: _matched(wh, wh.attendance_month.start, wh.attendance_month.end))


def _expected_days(wh: Warehouse, people: DataFrame, keys: list[str]) -> DataFrame:
    """Number of expected days and of the employees who have any, by arithmetic on each employee's range."""
    days = people.withColumn("_days", working_days(F.col("_first"), F.col("_last"), wh.rules.weekend_days)).where("_days > 0")
    return days.groupBy(*keys).agg(F.sum("_days").alias("_expected"), F.count("employee_id").alias("headcount"))


SUMS = {
    "absence_days": F.sum, "calculated_late_minutes": F.sum, "excused_late_minutes": F.sum, "calculated_net_late_minutes": F.sum,
    "missing_punch_count": F.sum, "_overtime": F.sum, "_early": F.sum, "_rows": F.sum, "_days": F.sum, "_unclean": F.sum,
}


def _totals(matched: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """The sums over expected days, of which only those with a record are rows: a group without expected days gives none."""
    early = F.when(
        F.col("actual_check_out") < F.col("scheduled_end"), minute_boundaries("actual_check_out", "scheduled_end")
    ).otherwise(F.lit(0).cast("bigint"))
    rows = matched.select(
        *keys, "employee_id", "calendar_date", "absence_days", "calculated_late_minutes", "excused_late_minutes", "calculated_net_late_minutes",
        "missing_punch_count", F.when(F.col("overtime_approved"), F.col("overtime_hours")).alias("_overtime"), early.alias("_early"),
        F.lit(1).cast("bigint").alias("_rows"), F.when(_unclean(), 1).otherwise(0).cast("bigint").alias("_unclean"),
    )
    # A day with several records is one expected day: its records are summed before days are counted.
    by_day = rows.groupBy(*keys, "employee_id", "calendar_date").agg(*[f(c).alias(c) for c, f in SUMS.items() if c != "_days"]).withColumn("_days", F.lit(1).cast("bigint"))
    found = by_day.groupBy(*keys).agg(*[f(c).alias(c) for c, f in SUMS.items()])
    both = expected.unionByName(found, allowMissingColumns=True)
    sums = both.groupBy(*keys).agg(F.sum("_expected").alias("_expected"), F.sum("headcount").alias("headcount"), *[F.sum(c).alias(c) for c in SUMS])
    whole_ = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    absent = whole_("_expected") - whole_("_days")
    rows_ = absent + whole_("_rows")
    clean = F.when(rows_ == 0, 1.0).otherwise(1.0 - (absent + whole_("_unclean")).cast("double") / F.nullif(rows_.cast("double"), F.lit(0.0)))
    out = sums.select(
        *keys,
        whole_("_expected").alias("_expected"),
        whole_("headcount").alias("headcount"),
        clean.alias("attendance_compliance_pct"),
        F.round(F.coalesce("absence_days", F.lit(0.0)) + absent, 2).alias("absence_days"),
        whole_("calculated_late_minutes").alias("late_minutes"),
        whole_("excused_late_minutes").alias("excused_late_minutes"),
        whole_("calculated_net_late_minutes").alias("net_late_minutes"),
        whole_("_early").alias("early_leave_minutes"),
        whole_("missing_punch_count").alias("missing_punch_count"),
        F.round(F.coalesce("_overtime", F.lit(0.0)), 2).alias("overtime_hours"),
        absent.alias("absent"),
    )
    return out.where("_expected > 0").drop("_expected") if keys else out.drop("_expected")


@view("base_attendance_current")
def attendance_current(wh: Warehouse) -> DataFrame:
    return _attendance(wh, wh.attendance_month.start, wh.attendance_month.end)


@view("base_expected_attendance")
def expected_attendance(wh: Warehouse) -> DataFrame:
    return _expected(wh, wh.attendance_month.start, wh.attendance_month.end)


@view("base_attendance_payroll_overtime")
def attendance_payroll_overtime(wh: Warehouse) -> DataFrame:
    """Approved overtime hours against paid overtime, from both sides."""
    month = wh.attendance_month
    hours = (
        wh.table("attendance")
        .where(F.col("attendance_date").between(F.lit(month.start), F.lit(month.end)) & F.col("overtime_approved"))
        .groupBy("employee_id")
        .agg(F.sum("overtime_hours").alias("hours"))
    )
    paid = (
        wh.table("payroll")
        .where(F.col("payroll_period") == wh.payroll_month.label)
        .select("employee_id", F.col("overtime_amount").alias("cost"))
    )
    people = wh.view("base_employees_deduplicated").select("employee_id", "employee_name", "department", "project")
    hours_, cost = F.coalesce("hours", F.lit(0.0)), F.coalesce("cost", F.lit(0.0))
    return (
        full_join_unique(hours, paid, "employee_id")
        .join(people, "employee_id", "left")
        .select(
            "employee_id",
            "employee_name",
            "department",
            "project",
            hours_.alias("attendance_ot_hours"),
            cost.alias("payroll_ot_cost"),
            presence_status(hours_, cost, "Reconciled", "OT in Attendance only", "OT in Payroll only", "No Overtime").alias(
                "reconciliation_status"
            ),
        )
    )


@view("mart_attendance_exceptions")
def attendance_exceptions(wh: Warehouse) -> DataFrame:
    def rule(issue, when, **slots):
        return rule_from(ATTENDANCE, issue, when, **slots)

    punched_in, punched_out = F.col("actual_check_in").isNotNull(), F.col("actual_check_out").isNotNull()
    day, late = "calendar_date", "calculated_late_minutes"
    zero = F.lit(0).cast("bigint")
    source_late, source_net = F.coalesce("late_minutes", zero), F.coalesce("net_late_minutes", zero)
    hours, cost = F.col("attendance_ot_hours"), F.col("payroll_ot_cost")
    on_day = [
        rule("Missing Check-in", ~punched_in & punched_out, day=day),
        rule("Missing Check-out", punched_in & ~punched_out, day=day),
        rule("Both Punches Missing", ~punched_in & ~punched_out & (F.col("absence_days") == 0), day=day),
        rule("One Punch Only", punched_in != punched_out, day=day),
        rule(
            "Late Arrival Without Excuse",
            (F.col(late) > 0) & (F.coalesce("excused_late_minutes", zero) == 0),
            late=late,
            day=day,
        ),
        rule("Excused Late Exceeds Actual", F.col("excused_late_minutes") > F.col(late), excused="excused_late_minutes", late=late, day=day),
    ]
    if is_counting():
        # None of these rules fires on a day without a record, and how many such days there are is known without listing them.
        absent = _totals(_month_matched(wh), _expected_days(wh, _working(wh, wh.attendance_month.start, wh.attendance_month.end), []), [])
        days = [
            flag_rows(_month_matched(wh), on_day, "employee_id", None),
            flag_rows(absent, [rule("Missing Workday Attendance", F.lit(True), day=F.lit(None).cast("date"))], F.lit(None), None, weight="absent"),
        ]
    else:
        missing = rule("Missing Workday Attendance", F.col("attendance_date").isNull(), day=day)
        days = [flag_rows(wh.view("base_expected_attendance"), [*on_day, missing], "employee_id", "employee_name")]
    return stack(
        *days,
        flag_rows(
            wh.view("base_attendance_current"),
            [
                rule("Source Late Minutes Mismatch", source_late != F.col(late), source_late=source_late, late=late, day="attendance_date"),
                rule(
                    "Source Net Late Minutes Mismatch",
                    source_net != F.col("calculated_net_late_minutes"),
                    source_net=source_net,
                    net_late="calculated_net_late_minutes",
                    day="attendance_date",
                ),
                rule("Attendance for Inactive Employee", F.col("emp_status") == "Inactive", day="attendance_date"),
                rule("Attendance for Terminated Employee", F.col("emp_status") == "Terminated", day="attendance_date"),
                rule(
                    "Attendance for Unknown Employee",
                    F.col("record_classification") == "Unknown employee attendance",
                    day="attendance_date",
                    entity_name=F.lit("Unknown Employee"),
                ),
            ],
            "employee_id",
            "emp_name",
        ),
        flag_rows(
            wh.view("base_attendance_payroll_overtime"),
            [
                rule("Overtime Amount Missing", (hours > 0) & (cost == 0), hours=money_text(hours)),
                rule("Overtime Hours Missing", (cost > 0) & (hours == 0), cost=money_text(cost)),
            ],
            "employee_id",
            "employee_name",
        ),
    )


def _unclean() -> Column:
    """A workday with lateness, a missing punch or absence."""
    return (F.col("calculated_net_late_minutes") > 0) | (F.col("missing_punch_count") > 0) | (F.col("absence_days") > 0)


@view("mart_attendance_kpis")
def attendance_kpis(wh: Warehouse) -> DataFrame:
    expected = _expected_days(wh, _working(wh, wh.attendance_month.start, wh.attendance_month.end), [])
    row = side_by_side(
        _totals(_month_matched(wh), expected, []),
        wh.view("base_attendance_payroll_overtime").agg(total("payroll_ot_cost").alias("overtime_cost")),
        wh.number_of_issues("mart_attendance_exceptions", "attendance_exception_count"),
    )
    return row.select(
        "attendance_compliance_pct",
        "absence_days",
        "late_minutes",
        "excused_late_minutes",
        "net_late_minutes",
        "early_leave_minutes",
        "missing_punch_count",
        "overtime_hours",
        "overtime_cost",
        "attendance_exception_count",
    )


@view("mart_attendance_trend")
def attendance_trend(wh: Warehouse) -> DataFrame:
    """KPIs of the last months that have clock records, each against its own calendar.

    An employee's range is cut at the month ends: a row for each employee and
    month, not for each day.
    """
    month = wh.attendance_month
    earlier = wh.months_before("attendance", "attendance_date", month)
    first = (earlier[0] if earlier else month).start
    present = (
        wh.table("attendance")
        .where(F.col("attendance_date").between(F.lit(first), F.lit(month.end)))
        .select(F.date_format("attendance_date", "yyyy-MM").alias("month"))
        .distinct()
    )
    starts = F.sequence(F.trunc("_first", "month"), F.trunc("_last", "month"), F.expr("interval 1 month"))
    people = _working(wh, first, month.end).where("_first <= _last").withColumn("_start", F.explode(starts))
    people = people.withColumns({"_first": F.greatest("_first", "_start"), "_last": F.least("_last", F.last_day("_start")), "month": F.date_format("_start", "yyyy-MM")})
    matched = _matched(wh, first, month.end).withColumn("month", F.date_format("calendar_date", "yyyy-MM"))
    by_month = _totals(matched, _expected_days(wh, people, ["month"]), ["month"])
    return (
        by_month.join(present, "month", "left_semi")
        .select(
            "month",
            F.round("attendance_compliance_pct", 4).alias("attendance_compliance_pct"),
            "absence_days",
            F.col("late_minutes").cast("double").alias("late_minutes"),
            F.col("net_late_minutes").cast("double").alias("net_late_minutes"),
            F.col("missing_punch_count").cast("double").alias("missing_punch_count"),
            "overtime_hours",
        )
        .orderBy("month")
    )


def _by(wh: Warehouse, key: str, default: str, measures: list[str]) -> DataFrame:
    people = _working(wh, wh.attendance_month.start, wh.attendance_month.end)
    groups = _totals(_month_matched(wh), _expected_days(wh, people, [key]), [key]).select(key, *measures)
    paid = wh.view("base_attendance_payroll_overtime").where(F.col(key).isNotNull())
    with_cost = add_group_total(groups, [key], paid, total("payroll_ot_cost"), "overtime_cost")
    return with_cost.withColumn(key, F.coalesce(key, F.lit(default))).withColumnRenamed("missing_punch_count", "missing_punches")


@view("mart_attendance_by_project")
def attendance_by_project(wh: Warehouse) -> DataFrame:
    measures = ["headcount", "attendance_compliance_pct", "absence_days", "late_minutes", "missing_punch_count", "overtime_hours"]
    return _by(wh, "project", "Missing Project", measures)


@view("mart_attendance_by_department")
def attendance_by_department(wh: Warehouse) -> DataFrame:
    measures = [
        "headcount", "attendance_compliance_pct", "absence_days", "late_minutes", "net_late_minutes", "missing_punch_count", "overtime_hours",
    ]
    return _by(wh, "department", "Missing Department", measures)


PERSON = ("employee_id", "employee_name", "department", "project")


@view("mart_attendance_late_arrival")
def attendance_late_arrival(wh: Warehouse) -> DataFrame:
    return (
        _month_matched(wh)
        .groupBy(*PERSON)
        .agg(
            whole("calculated_late_minutes").alias("total_late_minutes"),
            whole("excused_late_minutes").alias("total_excused_minutes"),
            whole("calculated_net_late_minutes").alias("total_net_late_minutes"),
            tally(F.col("calculated_late_minutes") > 0).alias("late_arrival_incidents_count"),
        )
        .where("total_late_minutes > 0")
    )


@view("mart_attendance_overtime")
def attendance_overtime(wh: Warehouse) -> DataFrame:
    return wh.view("base_attendance_payroll_overtime")


@view("mart_attendance_missing_punches")
def attendance_missing_punches(wh: Warehouse) -> DataFrame:
    punched_in, punched_out = F.col("actual_check_in").isNotNull(), F.col("actual_check_out").isNotNull()
    return (
        _month_matched(wh)
        .groupBy(*PERSON)
        .agg(
            tally(~punched_in & punched_out).alias("missing_check_in_count"),
            tally(punched_in & ~punched_out).alias("missing_check_out_count"),
            whole("missing_punch_count").alias("total_missing_punches"),
        )
        .where("total_missing_punches > 0")
    )
