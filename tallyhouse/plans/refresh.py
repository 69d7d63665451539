"""A full refresh: intake, validation, issue table, checks, module checks, published views."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.reconcile import require
from tallyhouse.operators.tables import insert_missing, update_by_key
from tallyhouse.plans.all import Warehouse
from tallyhouse.plans.checks import CHECKS
from tallyhouse.plans.params import Rules
from tallyhouse.session import pin
from tallyhouse.sources import intake
from tallyhouse.sources.schemas import MODULE_CHECK_SCHEMA, SCHEMAS

# The module a domain of checks speaks for, where the names differ.
MODULE_OF = {"cases": "er", "command_center": "executive"}


def module_results(results: DataFrame) -> DataFrame:
    """One update row for each module: its checks passed or failed, and its views could be read."""
    passed = F.bool_and(F.coalesce("passed", F.lit(False)))
    return results.groupBy("module_key").agg(
        F.when(passed, "Passed").otherwise("Failed").alias("reconciliation_status"),
        F.lit("Healthy").alias("api_health_status"),
        F.lit(True).alias("required_marts_present"),
        F.current_timestamp().alias("last_checked_at"),
    )


def check_results(wh: Warehouse) -> DataFrame:
    """The checks of all modules with their module, stored; those of the overview read the health that these decide and are left out."""
    wh.settle_all(["base_active_workforce", "base_employees_deduplicated"])

    def results(domain: str) -> DataFrame:
        return pin(CHECKS[domain](wh).select(F.lit(MODULE_OF.get(domain, domain)).alias("module_key"), "*"))

    with ThreadPoolExecutor(4) as pool:  # short jobs share the executors
        return reduce(lambda a, b: a.unionByName(b), pool.map(results, [d for d in CHECKS if d != "command_center"]))


def module_check_rows(wh: Warehouse, checks: DataFrame) -> DataFrame:
    """One row for each module, stored: known modules are inserted as unknown and updated with their results.

    Modules without checks of their own: their views could be read, the rest stays unknown.
    """
    registry = wh.view("base_command_center_module_registry").select("module_key")
    unchecked = registry.join(checks.select("module_key").distinct(), "module_key", "left_anti")
    unchecked = unchecked.select("module_key", F.lit("Healthy").alias("api_health_status"), F.lit(True).alias("required_marts_present"))
    updates = module_results(checks).unionByName(unchecked, allowMissingColumns=True)
    unknown = registry.select(
        "module_key",
        *[F.lit("Unknown").alias(c) for c in ("api_health_status", "reconciliation_status")],
        F.lit(False).alias("required_marts_present"),
        F.lit("Unknown").alias("page_render_status"),
        F.lit(None).cast("timestamp").alias("last_checked_at"),
    )
    known = insert_missing(intake.empty(wh.spark, MODULE_CHECK_SCHEMA), unknown, ["module_key"])
    return pin(update_by_key(known, updates, ["module_key"]).select(known.columns))


def refresh(spark: SparkSession, csv_root: str, lake_root: str, rules: Rules | None = None, strict: bool = True) -> Warehouse:
    """Load every delivered file ``{csv_root}/{table}.csv`` and rebuild all results under ``lake_root``.

    Only new and changed files are read. Writes bronze and silver tables, the
    totals counted meanwhile (``gold/control_totals``), the issue table (``gold/data_quality``),
    the check results (``gold/checks``) and the module checks
    (``gold/module_checks``), and publishes the views. Missing core tables stop
    the refresh; failed checks do so at the end if ``strict``, after everything
    is written.
    """
    bronze, silver, gold = (f"{lake_root}/{layer}" for layer in ("bronze", "silver", "gold"))
    totals = []
    for name in SCHEMAS:
        if intake.exists(spark, f"{csv_root}/{name}.csv"):
            totals += intake.refresh_table(spark, name, f"{csv_root}/{name}.csv", bronze, silver)
    if totals:
        spark.createDataFrame(totals, intake.TOTALS).coalesce(1).write.mode("overwrite").parquet(f"{gold}/control_totals")
    wh = Warehouse(spark, intake.load_tables(spark, silver, production=True), rules)
    intake.write_issues(wh.settle("data_quality"), f"{gold}/data_quality")
    checks = check_results(wh)
    wh.module_checks = module_check_rows(wh, checks)
    wh.forget("command_center_module_checks")
    wh.module_checks.write.mode("overwrite").parquet(f"{gold}/module_checks")
    overall = CHECKS["command_center"](wh).select(F.lit(MODULE_OF["command_center"]).alias("module_key"), "*")
    results = pin(checks.unionByName(overall))
    results.write.mode("overwrite").parquet(f"{gold}/checks")
    wh.publish()
    if strict:
        require(results)
    return wh
