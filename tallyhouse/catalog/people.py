"""Every warehouse view as a query over people tables derived from the trade tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.catalog.people_sql import QUERIES, statement
from tallyhouse.plans.all import VIEWS, Warehouse
from tallyhouse.plans.checks import CHECKS
from tallyhouse.plans.reads import SUMMARIES, read
from tallyhouse.plans.refresh import check_results, module_check_rows
from tallyhouse.session import tune
from tallyhouse.sources.intake import stamp

# Views over literals only; they have no data to run on and are covered by tests.
LITERAL = {"base_command_center_module_registry", "command_center_module_checks"}

# Columns holding the time of the run.
VOLATILE = ("last_refresh_timestamp", "last_data_refresh")

_warehouses: dict[tuple[str, str, str], Warehouse] = {}


def warehouse(spark: SparkSession, folder: str) -> Warehouse:
    """One warehouse per application and state of a data folder, so queries share its views until the data change."""
    key = (spark.sparkContext.applicationId, folder, stamp(spark, folder))
    if key not in _warehouses:
        for old in [k for k in _warehouses if k[:2] == key[:2]]:
            del _warehouses[old]
        found = _warehouses[key] = Warehouse.over_trade_data(tune(spark), folder)
        # As in a refresh: the modules' own checks decide what is said of them.
        found.module_checks = lambda: found.stored("module checks", lambda: module_check_rows(found, check_results(found)))
    return _warehouses[key]


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return warehouse(spark, folder).view(name).drop(*VOLATILE)

    return run


def _checks(domain: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: CHECKS[domain](warehouse(spark, folder))


def _reading(path: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: read(warehouse(spark, folder), path)


def _all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _query(name) for name in VIEWS if name not in LITERAL}
    found.update({f"read_{module}_summary": _reading(f"{module}/summary") for module in SUMMARIES})
    found["read_payroll_variance"] = _reading("payroll/variance")
    found.update({f"checks_{domain}": _checks(domain) for domain in CHECKS})
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all()


def oracle_sql() -> dict[str, str]:
    return {name: statement(name) for name in _all() if name in QUERIES}
