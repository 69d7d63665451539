"""Register a query next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.session import tune
from tallyhouse.sources.trade import TABLES, read_table


class Trade:
    """The trade tables of one data folder, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.folder, name)
        raise AttributeError(name)


class Catalog:
    def __init__(self):
        self.functions: dict[str, Callable[[Trade], DataFrame]] = {}
        self.checks: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(function: Callable[[Trade], DataFrame]):
            self.functions[name] = function
            if sql:
                self.checks[name] = sql
            return function

        return add

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(function):
            return lambda spark, folder: function(Trade(tune(spark), folder))

        return {name: bind(function) for name, function in self.functions.items()}
