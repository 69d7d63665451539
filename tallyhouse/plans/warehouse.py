"""Named view layer: each view is a function from the warehouse to a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.rules import count_issues, counting
from tallyhouse.plans.params import Month, Rules
from tallyhouse.session import pin, size_joins
from tallyhouse.sources.derived_hr import derive
from tallyhouse.sources.intake import empty
from tallyhouse.sources.schemas import SCHEMAS

VIEWS: dict[str, Callable[["Warehouse"], DataFrame]] = {}


def view(name: str):
    """Register a function under the name of the view it defines."""

    def add(function: Callable[["Warehouse"], DataFrame]):
        VIEWS[name] = function
        return function

    return add


class Warehouse:
    """Source tables, rule settings and the views over them.

    Views stay lazy. The report months are the only values taken to the driver,
    one ``max`` each, so that period filters are literals the scan can use.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | Callable[[str], DataFrame], rules: Rules | None = None):
        self.spark = size_joins(spark)
        self.rules = rules or Rules()
        self._tables = tables
        self._views: dict[str, DataFrame] = {}
        self._settled: set[str] = set()
        self._counts: dict[str, DataFrame] = {}
        self._frames: dict[str, DataFrame] = {}
        self._locks: dict[str, Lock] = {}
        #: Rows of command_center_module_checks, or what makes them; a refresh fills them from its results.
        self.module_checks: DataFrame | Callable[[], DataFrame] | None = None

    @classmethod
    def over_trade_data(cls, spark: SparkSession, folder: str, rules: Rules | None = None) -> "Warehouse":
        found: dict[str, DataFrame] = {}

        def table(name: str) -> DataFrame:
            if name not in found:
                found[name] = derive(spark, folder, name)
            return found[name]

        return cls(spark, table, rules)

    def table(self, name: str) -> DataFrame:
        """A source table; one that was not delivered is empty but has its schema."""
        if callable(self._tables):
            return self._tables(name)
        return self._tables[name] if name in self._tables else empty(self.spark, SCHEMAS[name])

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            with counting(False):
                self._views[name] = VIEWS[name](self)
        return self._views[name]

    def counted(self, name: str) -> DataFrame:
        """The rules of an exception view with the number n of their issues; no sentence is built to be counted."""
        with counting():
            return count_issues(VIEWS[name](self))

    def number_of_issues(self, name: str, alias: str) -> DataFrame:
        """The number of all issues of an exception view, from its stored counts: the rules run once for all who ask."""
        return self.issue_counts([name])[name].agg(F.coalesce(F.sum("n"), F.lit(0)).alias(alias))

    def issue_counts(self, names: Sequence[str], at_once: int = 4) -> dict[str, DataFrame]:
        """Counts of several exception views, stored once: a row for each rule."""
        def store(name: str) -> DataFrame:
            with self._locks.setdefault(f"counts of {name}", Lock()):
                if name not in self._counts:
                    self._counts[name] = pin(self.counted(name))
            return self._counts[name]

        with ThreadPoolExecutor(at_once) as pool:
            return dict(zip(names, pool.map(store, names)))

    def settle(self, name: str) -> DataFrame:
        """Store a view once; every later plan of this warehouse reads the stored rows.

        Used for frames that several branches of one result read, such as the
        canonical candidates of the recruitment KPIs.
        """
        with self._locks.setdefault(name, Lock()):
            if name not in self._settled:
                self._views[name] = pin(self.view(name))
                self._settled.add(name)
        return self._views[name]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A frame that is no view but that several views read, stored once."""
        with self._locks.setdefault(f"frame {name}", Lock()):
            if name not in self._frames:
                with counting(False):
                    self._frames[name] = pin(build())
        return self._frames[name]

    def forget(self, *names: str) -> None:
        """Build these views anew when they are read next (all views if none is named)."""
        if not names:
            self._frames.clear()
        for name in names or list(self._views):
            self._views.pop(name, None)
            self._counts.pop(name, None)
            self._settled.discard(name)

    def settle_all(self, names: Sequence[str], at_once: int = 4) -> None:
        """Store independent views side by side, so that short jobs share the executors."""
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(self.settle, names))

    def publish(self, names: list[str] | None = None) -> None:
        """Create or replace a temporary SQL view per warehouse view."""
        for name in names or list(VIEWS):
            self.view(name).createOrReplaceTempView(name)

    def _latest(self, table: str, column: str) -> str | None:
        value = self.table(table).agg(F.max(column).cast("string").alias("m")).first()["m"]
        return value[:7] if value else None

    def months_before(self, table: str, column: str, month: Month) -> list[Month]:
        """The months of a source before a report month: one value a month reaches the driver."""
        label = F.substring(F.col(column).cast("string"), 1, 7).alias("m")
        found = self.table(table).select(label).where(F.col("m") < month.label).distinct().collect()
        months = sorted(r["m"] for r in found)
        if self.rules.trend_months is not None:
            first = month.back(self.rules.trend_months - 1).label
            months = [m for m in months if m >= first]
        return [Month(m) for m in months]

    def _month(self, table: str, column: str) -> Month:
        return Month(self.rules.report_month or self._latest(table, column) or self.rules.default_month)

    @cached_property
    def payroll_month(self) -> Month:
        return self._month("payroll", "payroll_period")

    @cached_property
    def attendance_month(self) -> Month:
        return self._month("attendance", "attendance_date")

    @cached_property
    def compliance_month(self) -> Month:
        return self._month("compliance", "period")

    @cached_property
    def case_month(self) -> Month:
        return self._month("employee_relations", "created_date")

    @cached_property
    def hiring_month(self) -> Month:
        return self._month("recruitment_requisitions", "approval_date")

    @cached_property
    def talent_month(self) -> Month:
        """Configured month, else latest review period, else latest course completion, else the default."""
        return Month(
            self.rules.talent_month
            or self.rules.report_month
            or self._latest("performance_reviews", "review_period")
            or self._latest("learning_enrollments", "completion_date")
            or self.rules.default_month
        )


def rule_from(texts: dict, issue: str, when, **slots):
    """An exception rule with its fixed wording."""
    from tallyhouse.functions import say
    from tallyhouse.operators.rules import Rule

    override = {k: slots.pop(k) for k in ("entity_id", "entity_name") if k in slots}
    text = texts[issue]
    return Rule(issue, text.severity, text.action, say(text.description, **slots), when, **override)
