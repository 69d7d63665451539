"""Catalogue queries against their checking SQL on the smallest data folder."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.compare import rows_of

# The training-data queries and their pipeline have tests of their own.
QUERIES, ORACLE = ({n: q for n, q in found.items() if not re.match(r"op\d+_|pipeline$", n)} for found in (entry.queries(), entry.oracle_sql()))

# The people views are compared in full by tools/compare.py; a sample keeps the test run short.
SAMPLE = (
    "mart_exec_kpis", "mart_payroll_exceptions", "mart_attendance_kpis", "mart_compliance_kpis", "base_er_cases_current", "mart_recruitment_trends",
    "mart_talent_kpis", "mart_workforce_distribution", "base_candidate_source_records", "data_quality",
)
NAMES = [n for n in QUERIES if not n.startswith(("mart_", "base_", "command_", "data_", "read_", "checks_"))] + list(SAMPLE)


def test_every_query_has_checking_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns, got = rows_of(df.columns, df.collect())
    result = duck.execute(ORACLE[name])
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    assert columns == want_columns
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 1
