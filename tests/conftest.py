from __future__ import annotations

import duckdb
import pytest

from tallyhouse.session import build_session
from tallyhouse.sources.trade import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores="4", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con


@pytest.fixture(scope="session")
def people(spark):
    from tallyhouse.plans.all import Warehouse
    from tests.people_fixture import tables

    return Warehouse(spark, tables(spark))
