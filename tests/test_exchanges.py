"""What large tables would send around: rows counted by their keys, issues stored once, joins sized by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse.operators.relational import with_repeat_flag
from tallyhouse.operators.rules import Mark, Rule, count_issues, counting, flag_marked, flag_repeats
from tallyhouse.plans.all import Warehouse
from tallyhouse.session import pin
from tests.people_fixture import tables


def rule(issue: str, when) -> Rule:
    return Rule(issue, "Critical", "a", F.lit("d"), when)


def counts(frame) -> dict:
    return {r.issue_type: r.n for r in count_issues(frame).collect()}


def test_files_that_shrink_are_not_gathered_on_the_driver(spark):
    Warehouse(spark, tables(spark))
    people = pin(spark.range(1000000).selectExpr("'Company' AS company", "concat('E', id) AS id", "'P' AS project", "'D' AS department"))
    plan = people.join(people.select("id"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_repeats_from_numbers_of_rows(spark):
    rows = spark.range(2500).selectExpr("'hot' AS k").union(spark.createDataFrame([("a",), ("b",), ("b",), (None,), (None,)], "k string"))
    found = flag_repeats(rows, ["k"], rule("twice", F.lit(True)), "k")
    assert {r.entity_id: r["count"] for r in found.groupBy("entity_id").count().collect()} == {"hot": 2500, "b": 2}
    with counting():
        assert counts(flag_repeats(rows, ["k"], rule("twice", F.lit(True)), "k")) == {"twice": 2502}


def test_marked_rules_are_counted_by_key(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 4)], "k string, v int")

    def frame():
        mark = Mark(["k"], lambda df, weight: with_repeat_flag(df, ["k"], "again", weight), [rule("again", F.col("again"))])
        return flag_marked(rows, [mark], [rule("large", F.col("v") > 2)], "v", None)

    assert counts(frame()) == {"again": 2, "large": 3}
    with counting():
        assert counts(frame()) == {"again": 2, "large": 3}


def test_counts_of_every_module_are_those_of_its_issues(people):
    for view in ("mart_recruitment_exceptions", "mart_talent_exceptions", "mart_er_exceptions"):
        told = {r[0]: r[1] for r in people.view(view).groupBy("issue_type").count().collect()}
        assert counts(people.counted(view)) == told


def test_one_module_is_listed_without_being_stored(spark):
    found = Warehouse(spark, tables(spark))
    assert found.view("base_command_exception_er").count() > 0
    assert "mart_er_exceptions" not in found._settled


def test_rules_run_once_for_all_who_count(spark):
    found = Warehouse(spark, tables(spark))
    found.view("mart_er_kpis")
    assert "mart_er_exceptions" in found._counts


def test_cases_are_numbered_in_their_own_columns(spark):
    found = Warehouse(spark, tables(spark))
    numbered = found.view("base_er_case_population")
    stored = [spark.read.parquet(f).columns for f in numbered.inputFiles() if "pinned" in f]
    assert stored and all("employee_name" not in c and "sla_status" not in c for c in stored if "case_id" in c)
