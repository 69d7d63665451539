"""Cross-module exceptions, freshness, health and overview."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import tally
from tallyhouse.operators.relational import distinct_values, side_by_side
from tallyhouse.operators.rules import conform, normal_severity, stack, summarise
from tallyhouse.operators.tables import insert_missing
from tallyhouse.plans.warehouse import Warehouse, view
from tallyhouse.sources.intake import empty
from tallyhouse.sources.schemas import MODULE_CHECK_SCHEMA

# Module registry: key, label, route, owner, KPI count, exception view (fixed values).
MODULES = (
    ("executive", "Executive Summary", "/executive", "Executive", 8, None),
    ("data-quality", "Data Quality", "/data-quality", "Data Quality", 7, "mart_data_quality_exceptions"),
    ("workforce", "Workforce", "/workforce", "Workforce", 5, "mart_workforce_exceptions"),
    ("payroll", "Payroll & Cost", "/payroll", "Payroll", 5, "mart_payroll_exceptions"),
    ("attendance", "Attendance", "/attendance", "Attendance", 5, "mart_attendance_exceptions"),
    ("compliance", "Saudization & Compliance", "/compliance", "Compliance", 6, "mart_compliance_exceptions"),
    ("er", "Employee Relations", "/er", "Employee Relations", 6, "mart_er_exceptions"),
    ("recruitment", "Recruitment & Hiring", "/recruitment", "Recruitment", 7, "mart_recruitment_exceptions"),
    ("talent", "Talent & Succession", "/talent", "Talent", 11, "mart_talent_exceptions"),
)


@view("base_command_center_report_context")
def report_context(wh: Warehouse) -> DataFrame:
    """The report month as the payroll source has it now, unless a month is set."""
    found = wh.table("payroll").agg(F.substring(F.max("payroll_period"), 1, 7).alias("m"))
    start = F.to_date(F.concat(F.coalesce(F.lit(wh.rules.report_month), "m", F.lit(wh.rules.default_month)), F.lit("-01")))
    return found.select(
        F.date_format(start, "yyyy-MM").alias("report_month"),
        F.date_format(start, "yyyy-MM-dd").alias("report_month_start"),
        F.date_format(F.last_day(start), "yyyy-MM-dd").alias("report_month_end"),
        F.current_timestamp().alias("last_refresh_timestamp"),
    )


@view("base_command_center_module_registry")
def module_registry(wh: Warehouse) -> DataFrame:
    rows = [(key, key, label, route, owner, kpis) for key, label, route, owner, kpis, _ in MODULES]
    return wh.spark.createDataFrame(
        rows, "module_key string, page_key string, module_label string, route_path string, owner_domain string, primary_kpi_count int"
    )


def _issues_of(key: str, source: str) -> str:
    """The view with a module's issues."""
    return "data_quality" if key == "data-quality" else source


def _define_feed(name: str, key: str, label: str, route: str, source: str) -> None:
    @view(name)
    def feed(wh: Warehouse) -> DataFrame:
        # Not stored: one module's issues are read once, and counts have no need of them.
        return conform(wh.view(_issues_of(key, source)), key, label, source, route)


FEEDS = []
for _key, _label, _route, _, _, _source in MODULES:
    if _source:
        _name = "base_command_exception_" + _key.replace("-", "_")
        FEEDS.append(_name)
        _define_feed(_name, _key, _label, _route, _source)


@view("base_command_center_exception_sources")
def exception_sources(wh: Warehouse) -> DataFrame:
    # Every module's rules read the two employee populations.
    wh.settle_all(["base_active_workforce", "base_employees_deduplicated"])
    modules = [(key, label, route, source) for key, label, route, _, _, source in MODULES if source]
    # Stored one by one: all rule sets in one plan would be too much to plan at once.
    wh.settle_all([_issues_of(key, source) for key, _, _, source in modules])
    feeds = [conform(wh.view(_issues_of(key, source)), key, label, source, route) for key, label, route, source in modules]
    return stack(*feeds).withColumn("severity", normal_severity("severity"))


def number_listed(wh: Warehouse, alias: str) -> DataFrame:
    """The number of rows of all feeds: each feed is gone through and only its number stored."""
    wh.settle_all(["base_active_workforce", "base_employees_deduplicated"])

    def number(name: str) -> DataFrame:
        return wh.stored(f"rows of {name}", lambda: wh.view(name).agg(F.count(F.lit(1)).alias("n")))

    with ThreadPoolExecutor(4) as pool:  # short jobs share the executors
        return stack(*pool.map(number, FEEDS)).agg(F.sum("n").alias(alias))


def _counted(wh: Warehouse) -> DataFrame:
    """All modules' rules with the number n of their issues, in the columns of the feeds."""
    wh.settle_all(["base_active_workforce", "base_employees_deduplicated"])
    modules = [(key, label, route, source) for key, label, route, _, _, source in MODULES if source]
    named = {source: _issues_of(key, source) for key, _, _, source in modules}
    counts = wh.issue_counts(list(named.values()))
    feeds = [
        counts[named[source]].select(
            F.lit(key).alias("module_key"), F.lit(label).alias("module_label"), F.lit(source).alias("source_mart"), F.lit(route).alias("route_path"),
            "issue_type", "recommended_action", normal_severity("severity").alias("severity"), "n",
        )
        for key, label, route, source in modules
    ]
    return stack(*feeds)


@view("base_command_center_data_freshness")
def data_freshness(wh: Warehouse) -> DataFrame:
    """Latest business date per source; one ``max`` per table."""

    def latest(module: str, table: str, column) -> DataFrame:
        return wh.table(table).agg(F.max(column).cast("string").alias("max_source_date")).select(
            F.lit(module).alias("module_key"), F.lit(table).alias("source_table"), "max_source_date"
        )

    return stack(
        latest("payroll", "payroll", "payroll_period"),
        latest("attendance", "attendance", "attendance_date"),
        latest("recruitment", "recruitment_requisitions", "approval_date"),
        latest("talent", "performance_reviews", "completed_date"),
        latest("compliance", "compliance", "period"),
        latest("er", "employee_relations", F.coalesce("closed_date", "created_date")),
        latest("workforce", "employees", "joining_date"),
    )


@view("mart_command_center_data_freshness")
def freshness(wh: Warehouse) -> DataFrame:
    month = wh.payroll_month
    latest, module = F.col("max_source_date"), F.col("module_key")
    end = str(month.end)
    by_month = {"payroll": "Payroll period", "compliance": "Compliance period", "er": "ER period"}
    stale = F.when(latest.isNull(), F.lit("No transaction data found in source table"))
    stale = stale.when(
        (module == "attendance") & (latest < end),
        F.concat(F.lit("Attendance date "), latest, F.lit(f" is older than expected report month end {end}")),
    )
    for key, label in by_month.items():
        stale = stale.when(
            (module == key) & (latest < month.label),
            F.concat(F.lit(f"{label} "), latest, F.lit(f" is older than expected report month {month.label}")),
        )
    sources = wh.view("base_command_center_data_freshness").withColumn("_stale", stale)
    any_stale = sources.agg(F.coalesce(F.bool_or(F.col("_stale").isNotNull()), F.lit(False)).alias("_any"))
    registry = wh.view("base_command_center_module_registry").select("module_key", "module_label")
    default_source = (
        F.when(module == "executive", "mart_exec_kpis").when(module == "data-quality", "data_quality").otherwise("derived")
    )
    # The registry and the source list are nine and seven rows.
    rows = registry.join(F.broadcast(sources), "module_key", "left").withColumn("_any", any_stale.scalar())
    return rows.select(
        "module_key",
        "module_label",
        F.coalesce("source_table", default_source).alias("source_table"),
        F.coalesce("max_source_date", F.lit(end)).alias("max_source_date"),
        F.current_timestamp().alias("last_refresh_timestamp"),
        F.when(module == "executive", F.col("_any")).otherwise(F.col("_stale").isNotNull()).alias("stale_flag"),
        F.when(module == "executive", "Derived from overall system state")
        .when(module == "data-quality", "Refreshed during DQ pipeline run")
        .otherwise(F.coalesce("_stale", F.lit("Data is current")))
        .alias("stale_reason"),
    )


@view("command_center_module_checks")
def module_checks(wh: Warehouse) -> DataFrame:
    """Check results per module; modules without a result are added as unknown."""
    held = wh.module_checks() if callable(wh.module_checks) else wh.module_checks
    existing = held if held is not None else empty(wh.spark, MODULE_CHECK_SCHEMA)
    unknown = wh.view("base_command_center_module_registry").select(
        "module_key",
        F.lit("Unknown").alias("api_health_status"),
        F.lit("Unknown").alias("reconciliation_status"),
        F.lit(False).alias("required_marts_present"),
        F.lit("Unknown").alias("page_render_status"),
        F.lit(None).cast("timestamp").alias("last_checked_at"),
    )
    return insert_missing(existing, unknown, ["module_key"])


@view("base_command_center_module_status")
def module_status(wh: Warehouse) -> DataFrame:
    severity = F.col("severity")
    issues = _counted(wh).groupBy("module_key").agg(
        *[F.coalesce(F.sum(F.when(severity == s, F.col("n"))), F.lit(0)).alias(s.lower()) for s in ("Critical", "Warning")]
    )
    stale = wh.view("mart_command_center_data_freshness").select("module_key", F.col("stale_flag").alias("_stale"))
    checks = wh.view("command_center_module_checks")
    unknown, no = F.lit("Unknown"), F.lit(False)
    return (
        wh.view("base_command_center_module_registry")
        .join(issues, "module_key", "left")
        .join(stale, "module_key", "left")
        .join(checks, "module_key", "left")
        .select(
            "module_key",
            "module_label",
            "route_path",
            "owner_domain",
            F.coalesce("api_health_status", unknown).alias("api_health_status"),
            F.coalesce("reconciliation_status", unknown).alias("reconciliation_status"),
            F.coalesce("required_marts_present", no).alias("required_marts_present"),
            F.coalesce("_stale", no).alias("stale_flag"),
            F.coalesce("critical", F.lit(0)).alias("critical_exception_count"),
            F.coalesce("warning", F.lit(0)).alias("warning_exception_count"),
            "primary_kpi_count",
        )
    )


def health(api, checks, present, stale, critical, warning):
    """Health decision: Critical before Unknown before Warning before Healthy."""
    return (
        F.when((api == "Unhealthy") | ~present | (checks == "Failed") | (critical > 0), "Critical")
        .when((api == "Unknown") | (checks == "Unknown"), "Unknown")
        .when((warning > 0) | stale, "Warning")
        .when((api == "Healthy") & (checks == "Passed"), "Healthy")
        .otherwise("Unknown")
    )


@view("mart_command_center_module_health")
def module_health(wh: Warehouse) -> DataFrame:
    rows = wh.view("base_command_center_module_status")
    status = health(
        F.col("api_health_status"), F.col("reconciliation_status"), F.col("required_marts_present"), F.col("stale_flag"),
        F.col("critical_exception_count"), F.col("warning_exception_count"),
    )
    return rows.withColumn("status", status)


KPI_VIEWS = (
    "mart_workforce_kpis", "mart_payroll_kpis", "mart_attendance_kpis", "mart_compliance_kpis", "mart_er_kpis", "mart_recruitment_kpis",
    "mart_talent_kpis", "mart_data_quality_summary",
)


@view("command_center_overview_data")
def overview_data(wh: Warehouse) -> DataFrame:
    """Headline numbers of all modules in one row."""
    # Feeds and KPI rows are stored first: the row below then reads a handful of
    # small stored frames instead of re-planning every module.
    issues = _counted(wh).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_active_exceptions"))
    healthy = wh.view("mart_command_center_module_health").agg(tally(F.col("status") == "Healthy").alias("modules_healthy"))
    latest = wh.view("base_command_center_data_freshness").agg(F.max("max_source_date").alias("latest_source_business_date"))

    wh.settle_all(KPI_VIEWS)

    def kpi(view: str, column: str, name: str | None = None) -> DataFrame:
        return wh.settle(view).select(F.col(column).alias(name or column))

    row = side_by_side(
        kpi("mart_workforce_kpis", "active_headcount"),
        kpi("mart_payroll_kpis", "total_payroll_cost", "payroll_cost"),
        kpi("mart_attendance_kpis", "attendance_compliance_pct"),
        kpi("mart_compliance_kpis", "saudization_pct"),
        kpi("mart_er_kpis", "total_open_er_cases", "open_er_cases"),
        kpi("mart_recruitment_kpis", "open_requisitions"),
        kpi("mart_talent_kpis", "review_completion_pct"),
        issues,
        healthy,
        wh.view("base_command_center_report_context").select(F.col("last_refresh_timestamp").alias("last_data_refresh")),
        latest,
        kpi("mart_data_quality_summary", "data_quality_score"),
    )
    whole = ("active_headcount", "open_er_cases", "open_requisitions", "total_active_exceptions", "modules_healthy")
    return row.select(*[F.col(c).cast("bigint").alias(c) if c in whole else F.col(c) for c in row.columns])


@view("mart_command_center_overview")
def overview(wh: Warehouse) -> DataFrame:
    return wh.view("command_center_overview_data")


@view("mart_command_center_exception_summary")
def exception_summary(wh: Warehouse) -> DataFrame:
    return summarise(_counted(wh), F.col("n")).drop("source_mart")


@view("mart_command_center_priority_alerts")
def priority_alerts(wh: Warehouse) -> DataFrame:
    urgent_first = F.when(F.col("severity") == "Critical", 1).otherwise(2)
    return (
        summarise(_counted(wh), F.col("n"))
        .select(
            F.concat_ws("_", "module_key", "issue_type").alias("alert_id"),
            "module_key",
            "module_label",
            "severity",
            "issue_type",
            F.col("exception_count").alias("issue_count"),
            "recommended_action",
            "source_mart",
            "route_path",
        )
        .orderBy(urgent_first, F.desc("issue_count"), "alert_id")
    )


# Name of a filter and the employee column with its values (fixed values).
FILTERS = {"company": "companies", "project": "projects", "department": "departments", "cost_center": "cost_centers", "nationality": "nationalities"}


@view("mart_command_center_filter_options")
def filter_options(wh: Warehouse) -> DataFrame:
    """What can be chosen, a row for each filter and value."""
    found = distinct_values(wh.table("employees"), list(FILTERS))
    named = F.create_map(*[F.lit(x) for pair in FILTERS.items() for x in pair])
    values = found.select(F.element_at(named, F.col("field")).alias("filter"), "value")
    modules = wh.view("base_command_center_module_registry").select(F.lit("modules").alias("filter"), F.col("module_key").alias("value"))
    return values.unionByName(modules).select(F.lit(wh.payroll_month.label).alias("report_month"), "filter", "value")
