"""Operators against brute force in plain Python, with NULLs, ties and hot keys."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.functions import floor_zero, is_blank, is_empty, minute_boundaries, money_text, percent, ratio, say
from tallyhouse.functions.columns import expiry_bucket
from tallyhouse.operators import privacy, quality
from tallyhouse.operators import relational as rel
from tallyhouse.operators import temporal as tm
from tallyhouse.operators.identity import surrogate_id
from tallyhouse.operators.reconcile import ReconciliationError, require
from tallyhouse.session import scratch_dir
from tallyhouse.operators.rules import Rule, conform, flag_rows, normal_severity, stack, summarise
from tallyhouse.operators.tables import insert_missing, update_by_key

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def values(df, column=None):
    return [r[column or df.columns[0]] for r in df.collect()]


# ------------------------------------------------------------ columns
def test_blank_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("x",)], "a string")
    assert values(df.select(is_blank("a").alias("v"))) == [True, True, True, False]
    assert values(df.select(is_empty("a").alias("v"))) == [True, True, False, False]


def test_ratio_policies(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (1, None)], "a int, b int")
    assert values(df.select(ratio("a", "b", 1.0).alias("v"))) == [0.25, 1.0, 1.0]
    assert values(df.select(percent("a", "b", 100.0).alias("v"))) == [25.0, 100.0, 100.0]


def test_minute_boundaries(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 8, 0, 30), datetime(2024, 1, 1, 8, 20, 10))], "a timestamp_ntz, b timestamp_ntz")
    assert values(df.select(minute_boundaries("a", "b").alias("v"))) == [20]
    assert values(df.select(floor_zero(minute_boundaries("b", "a")).alias("v"))) == [0]


def test_say_fills_missing_parts(spark):
    df = spark.createDataFrame([("x", 12345678.0), (None, 1.0)], "a string, b double")
    assert values(df.select(say("{a} has {b}", b=money_text("b")).alias("v"))) == ["x has 12345678.00", "N/A has 1.00"]


def test_expiry_bucket_edges(spark):
    anchor = date(2026, 6, 30)
    days = [-1, 0, 30, 31, 60, 61, 90, 91]
    df = spark.createDataFrame([(anchor + timedelta(days=n),) for n in days] + [(None,)], "e date")
    assert values(df.select(expiry_bucket("e", F.lit(anchor)).alias("v"))) == [
        "expired", "0_30", "0_30", "31_60", "31_60", "61_90", "61_90", "90_plus", "missing_date",
    ]


def test_aging_band_edges(spark):
    df = spark.createDataFrame([(n,) for n in (0, 3, 4, 7, 8, 14, 15, 30, 31, -1, None)], "d int")
    assert values(df.select(tm.aging_band(F.col("d")).alias("v"))) == [
        "0_3_days", "0_3_days", "4_7_days", "4_7_days", "8_14_days", "8_14_days", "15_30_days", "15_30_days", "30_plus_days", "30_plus_days", "30_plus_days",
    ]


# ------------------------------------------------------------ row numbers
@SLOW
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.text("ab", max_size=2)), min_size=1, max_size=60))
def test_surrogate_id_is_the_sorted_position(spark, rows):
    df = spark.createDataFrame(rows, "a int, b string").repartition(3)
    got = sorted((r.n, r.a, r.b) for r in surrogate_id(df, ["a", "b"], "n").collect())
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert [g[0] for g in got] == list(range(1, len(rows) + 1))
    assert [(g[1], g[2]) for g in got] == want


def test_surrogate_id_spreads_equal_rows(spark):
    """A third of all rows share one key; they still spread over partitions."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = surrogate_id(df, ["k"], "n")
        sizes = numbered.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert numbered.agg(F.count_distinct("n"), F.max("n")).first()[:] == (9000, 9000)
    assert max(r["count"] for r in sizes) < 4500


# ------------------------------------------------------------ relational shapes
def test_latest_record_keeps_one_row_per_key(spark):
    rows = [("a", 1, "x"), ("a", None, "y"), ("a", 3, "z"), (None, 2, "n"), ("b", None, "q")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    got = {r.k: r.v for r in rel.latest_record(df, ["k"], [F.desc_nulls_last("o")]).collect()}
    assert got == {"a": "z", None: "n", "b": "q"}


def test_latest_record_limits_before_the_exchange(spark):
    plan = rel.latest_record(spark.range(10).withColumn("k", F.col("id") % 2), ["k"], [F.desc("id")])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_membership_null_rules(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    assert values(rel.keep_members(df, "k", keys)) == ["a"]
    assert values(rel.drop_members(df, "k", keys)) == ["b"]
    assert sorted(values(rel.drop_members(df, "k", keys, null_passes=True)), key=str) == [None, "b"]
    flags = {r.k: r.f for r in rel.with_member_flag(df, "k", keys, "f").collect()}
    assert flags == {"a": True, "b": False, None: False}


def test_repeat_flag_keeps_null_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    got = Counter((r.k, r.f) for r in rel.with_repeat_flag(df, ["k"], "f").collect())
    assert got == {("a", True): 2, ("b", False): 1, (None, False): 2}


def test_side_by_side_survives_an_empty_frame(spark):
    one = spark.createDataFrame([(1, "x")], "a int, b string")
    none = spark.createDataFrame([], "c date")
    row = rel.side_by_side(one, none).first()
    assert (row.a, row.b, row.c) == (1, "x", None)
    assert "Cartesian" not in rel.side_by_side(one, none)._jdf.queryExecution().toString()


def test_full_join_unique_equals_a_full_join(spark):
    unique = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, u int")
    rows = spark.createDataFrame([("a", 10), ("a", 11), ("c", 12), (None, 13)], "k string, v int")
    got = Counter((r.k, r.u, r.v) for r in rel.full_join_unique(unique, rows, "k").collect())
    want = Counter((r.k, r.u, r.v) for r in unique.join(rows, "k", "full").collect())
    assert got == want


def test_group_total_gives_zero_for_null_groups(spark):
    groups = spark.createDataFrame([("a",), (None,)], "k string")
    facts = spark.createDataFrame([("a", 1.5), (None, 9.0)], "k string, v double")
    got = {r.k: r.s for r in rel.add_group_total(groups, ["k"], facts, F.sum("v"), "s").collect()}
    assert got == {"a": 1.5, None: 0.0}


def test_count_entities_counts_keys_not_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 5), (None, 1)], "k string, v int")
    row = rel.count_entities(df, "k", n=F.lit(True), small=F.col("v") < 3).first()
    assert (row.n, row.small) == (2, 1)


def test_browse_pages(spark):
    df = spark.createDataFrame([(i, f"Name {i}") for i in range(20)], "id int, name string")
    got = values(rel.browse(df, ["id", "name"], "NAME 1", [F.asc("id")], page=1))
    assert got == [14, 15, 16, 17, 18]


# ------------------------------------------------------------ temporal
DAYS = st.integers(0, 60).map(lambda n: date(2026, 1, 1) + timedelta(days=n))


@SLOW
@given(st.lists(st.tuples(st.sampled_from("abc"), DAYS, st.one_of(st.none(), DAYS)), max_size=20))
def test_as_of_count_equals_brute_force(spark, rows):
    ends = [date(2026, 1, 10), date(2026, 1, 31), date(2026, 2, 20)]
    df = spark.createDataFrame(rows, "k string, s date, e date")
    got = {r.as_of_date: r.headcount for r in tm.as_of_count(df, "k", "s", "e", ends).collect()}
    assert got == {d: len({k for k, s, e in rows if s <= d and (e is None or e > d)}) for d in ends}


@SLOW
@given(st.lists(st.tuples(DAYS, DAYS), max_size=10))
def test_expand_days_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "s date, e date")
    got = Counter(values(tm.expand_days(df, F.col("s"), F.col("e"), "d", ("Friday",)), "d"))
    want = Counter()
    for s, e in rows:
        for n in range((e - s).days + 1):
            if (s + timedelta(days=n)).weekday() != 4:
                want[s + timedelta(days=n)] += 1
    assert got == want


def test_sla_status(spark):
    day = date(2026, 6, 15)
    rows = [(day, None, None), (None, None, day), (day, day, day), (day, date(2026, 6, 16), day), (day, None, day), (day, None, date(2026, 7, 15))]
    df = spark.createDataFrame(rows, "o date, c date, d date")
    status = tm.sla_status(F.col("o"), F.col("c"), F.col("d"), F.lit(date(2026, 6, 30)))
    assert values(df.select(status.alias("v"))) == ["Not Eligible", "Not Eligible", "Compliant", "Breached", "Breached", "Pending"]


def test_entity_months(spark):
    df = spark.createDataFrame([("a", date(2026, 1, 15), date(2026, 3, 1)), ("b", date(2026, 2, 1), None), ("c", date(2027, 1, 1), None)], "k string, s date, e date")
    months = tm.entity_months(df, "k", F.col("s"), F.col("e"), date(2026, 2, 1), date(2026, 4, 30))
    assert sorted((r.k, r.month_start.month) for r in months.collect()) == [("a", 2), ("a", 3), ("b", 2), ("b", 3), ("b", 4)]


# ------------------------------------------------------------ rules
def test_flag_rows_reads_once_and_ignores_null_predicates(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 9)], "k string, v int")
    rules = [
        Rule("Low", "warning", "x", say("v is {v}"), F.col("v") < 5),
        Rule("Any", "CRITICAL", "y", F.lit("always"), F.lit(True), entity_id=F.concat(F.lit("id-"), "k")),
    ]
    issues = flag_rows(df, rules, "k", None)
    assert sorted((r.entity_id, r.issue_type) for r in issues.collect()) == [("a", "Low"), ("id-a", "Any"), ("id-b", "Any"), ("id-c", "Any")]
    feed = stack(conform(issues, "m", "M", "src", "/m")).withColumn("severity", normal_severity("severity"))
    counts = {r.issue_type: (r.severity, r.exception_count) for r in summarise(feed).collect()}
    assert counts == {"Low": ("Warning", 1), "Any": ("Critical", 3)}


# ------------------------------------------------------------ tables
def test_keyed_tables(spark):
    old = spark.createDataFrame([("a", "ok", 1), ("b", "ok", 2)], "k string, s string, n int")
    new = spark.createDataFrame([("b", "new", 9), ("c", "new", 3)], "k string, s string, n int")
    assert sorted(insert_missing(old, new, ["k"]).collect()) == [("a", "ok", 1), ("b", "ok", 2), ("c", "new", 3)]
    updates = spark.createDataFrame([("b", "bad", None), ("z", "bad", 5)], "k string, s string, n int")
    assert sorted(update_by_key(old, updates, ["k"]).collect()) == [("a", "ok", 1), ("b", "bad", 2)]


# ------------------------------------------------------------ quality and privacy
def test_violations_with_nulls(spark):
    ids = spark.createDataFrame([("E1",)], "id string")
    df = spark.createDataFrame([("E1", 5, "2024-02-29"), (None, None, None), ("X", -1, "2023-02-29"), ("X", 7, "29/02/2024")], "id string, n int, day string")
    checks = [
        quality.Check("present", ("id",), "NOT_NULL", "Reject"),
        quality.Check("format", ("id",), "REGEX", value="^E[0-9]$"),
        quality.Check("known", ("id",), "FOREIGN_KEY", reference=ids),
        quality.Check("day", ("day",), "DATE_VALID"),
        quality.Check("range", ("n",), "IN_RANGE", "Flag", (0, 6)),
        quality.Check("single", ("id",), "UNIQUE", "Deduplicate"),
    ]
    got = Counter((r.id, r.rule_name) for r in quality.violations(df, checks, ["id"]).collect())
    assert got == {
        (None, "present"): 1, ("X", "format"): 2, ("X", "known"): 2, ("X", "day"): 2, ("X", "range"): 2, ("X", "single"): 2,
    }
    assert Counter(values(quality.with_disposition(df, checks), "disposition")) == {"Accept": 1, "Reject": 1, "Quarantine": 2}


def test_masking_examples(spark):
    df = spark.createDataFrame([("1098765432", "Khalid Al-Mansoori", "EMP-0019")], "n string, p string, k string")
    assert values(df.select(privacy.mask_part("n").alias("v"))) == ["1098******"]
    assert values(df.select(privacy.mask_part("n", keep="right").alias("v"))) == ["******5432"]
    assert values(df.select(privacy.pseudonym("p", "k").alias("v"))) == ["K.A. (EMP-0019)"]
    text = spark.createDataFrame([("Deduction of 1,500.50 SAR, ask a.b@corp.com",)], "t string")
    assert values(text.select(privacy.redact_entities("t").alias("v"))) == ["Deduction of [MONEY], ask [EMAIL]"]


def test_pattern_scan(spark):
    rows = [(1, "id 1098765432 and 2098765432, not 10987654321"), (2, "iban sa8000000123456789012345 x"), (3, "mail a@example.com b@synthetic.local c@corp.sa"), (4, "clean")]
    found = {(r.id, r.pattern): r.hits for r in privacy.scan_text(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert found == {(1, "national_id"): 2, (2, "iban"): 1, (3, "email"): 1}


def test_tokens_are_stable_and_never_collide(spark):
    known = spark.createDataFrame([("b", 7), ("a", 9999)], "k string, token_number bigint")
    keys = spark.createDataFrame([("a",), ("c",), ("c",), ("d",), (None,)], "k string")
    got = {r.k: r.token for r in privacy.extend_tokens(keys, known).collect()}
    assert got == {"b": "SUCC-0007", "a": "SUCC-9999", "c": "SUCC-10000", "d": "SUCC-10001"}


def test_role_views_cover_every_role(spark):
    df = spark.createDataFrame([("E1", "Sara Ali", 10.0, "E2")], "employee_id string, employee_name string, basic_salary double, successor_employee_key string")
    assert set(privacy.ROLE_FIELDS) == set(privacy.EXPORT_SCOPE)
    shown = {role: privacy.role_view(df, access, "employee_id").first().asDict() for role, access in privacy.ROLE_FIELDS.items()}
    assert shown["admin_system"] == {"employee_id": "E1", "employee_name": "Sara Ali", "basic_salary": 10.0, "successor_employee_key": "E. (E1)"}
    assert shown["payroll_manager"] == {"employee_id": "E1", "employee_name": "S.A. (E1)", "basic_salary": 10.0}
    assert shown["viewer_executive_aggregate_only"] == {"employee_id": "E1"}


def test_hidden_columns_are_not_read(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([("E1", "S", 1.0)], "employee_id string, employee_name string, basic_salary double").write.parquet(path)
    plan = privacy.role_view(spark.read.parquet(path), privacy.ROLE_FIELDS["project_manager"], "employee_id")._jdf.queryExecution().executedPlan().toString()
    assert "basic_salary" not in plan


def test_retention_and_holds(spark):
    df = spark.createDataFrame([("a", date(2026, 1, 1)), ("b", date(2026, 1, 1)), ("c", date(2026, 6, 1))], "k string, d date")
    holds = spark.createDataFrame([("b",)], "k string")
    assert values(privacy.retention_due(df, "d", 90, F.lit(date(2026, 6, 30)), holds, "k"), "k") == ["a"]


def test_contract_report(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (0, "z")], "id int, s string")
    field = quality.FieldContract
    rows = {r.field: r for r in quality.contract_report(df, [field("id", "int", unique=True, minimum=1), field("s", "date", required=True, allowed=("a",)), field("gone", "int")]).collect()}
    assert (rows["id"].type_ok, rows["id"].repeated, rows["id"].below_minimum) == (True, 1, 1)
    assert (rows["s"].type_ok, rows["s"].missing, rows["s"].not_allowed) == (False, 1, 1)
    assert rows["gone"].type_ok is False


def test_file_gate(spark):
    names = spark.createDataFrame([("jisr_employee_master_20260601.csv",), ("jisr_employee_master_2026.csv",), ("successfactors_talent_20260601.xlsx",)], "f string")
    got = {r.f: (r.source_category, r.gate) for r in quality.gate_files(names, "f").collect()}
    assert got["jisr_employee_master_20260601.csv"] == ("HRIS / Employee Master", "Accept")
    assert got["jisr_employee_master_2026.csv"] == (None, "Quarantine File")
    assert got["successfactors_talent_20260601.xlsx"][1] == "Accept"


def test_unknown_rule_kind(spark):
    with pytest.raises(ValueError):
        quality.mark_violations(spark.range(1), [quality.Check("x", ("id",), "MAGIC")])


# ------------------------------------------------------------ stores, assertions, masks
class _Cluster:
    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = self, self
        self.master, self.folder = master, folder

    def get(self, key, default=None):
        return self.folder or default


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(_Cluster(master), "t")
    assert scratch_dir(_Cluster(master, "s3a://bucket/x/"), "t").startswith("s3a://bucket/x/t-")
    assert scratch_dir(_Cluster("local[4]"), "t")


def test_require_names_every_failed_check(spark):
    rows = [(f"c{i}", 1.0, 2.0, False if i % 2 else None) for i in range(150)] + [("good", 1.0, 1.0, True)]
    df = spark.createDataFrame(rows, "check_name string, expected double, actual double, passed boolean")
    with pytest.raises(ReconciliationError) as error:
        require(df)
    assert str(error.value).startswith("150 checks failed") and "c149" in str(error.value) and "good" not in str(error.value)


def test_short_values_are_hidden_whole(spark):
    df = spark.createDataFrame([("Ali",), ("Omar",), ("Omars",), ("",), (None,)], "n string")
    assert values(df.select(privacy.mask_part("n").alias("v"))) == ["***", "****", "Omar*", "", None]
    assert values(df.select(privacy.mask_part("n", keep="right").alias("v"))) == ["***", "****", "*mars", "", None]


def test_look_alike_domains_are_reported(spark):
    texts = ["a@example.com", "a@example.com.", "a@example.com.evil.org", "a@example.community.org", "b@synthetic.local, c@x.net", "a@sub.example.com"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert sorted((r.k, r.hits) for r in privacy.scan_text(df, "k", "t").collect()) == [(2, 1), (3, 1), (4, 1), (5, 1)]


def test_side_by_side_refuses_what_it_would_merge(spark):
    one = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="several frames"):
        rel.side_by_side(one, one)
    with pytest.raises(Exception, match="more than one row"):
        rel.side_by_side(spark.createDataFrame([(1,), (7,)], "a int"), spark.createDataFrame([(2,)], "b int")).collect()


def test_numbers_do_not_depend_on_the_partitioning(spark):
    rows = spark.range(400).selectExpr("id % 5 AS k", "id AS payload")
    first, second = ({r.payload: r.n for r in surrogate_id(rows.repartition(p), ["k"], "n").collect()} for p in (2, 7))
    assert first == second


def test_unlisted_columns_are_hidden(spark):
    df = spark.createDataFrame([("E1", "x", "Ops")], "employee_id string, home_address string, department string")
    assert privacy.role_view(df, privacy.ROLE_FIELDS["admin_system"], "employee_id", ["department"]).columns == ["employee_id", "department"]


def test_export_scopes(spark):
    rows = [(f"E{i}", "Sara Ali", 10.0, "SA1", "P1", "Ops" if i < 6 else "Small") for i in range(8)]
    df = spark.createDataFrame(rows, "employee_id string, employee_name string, basic_salary double, bank_account_iban string, passport_number string, department string")
    for role in privacy.ROLE_FIELDS:
        taken = privacy.export(df, role, "employee_id", ["department"])
        assert not {"bank_account_iban", "passport_number", "national_id_number"} & set(taken.columns)
    totals = privacy.export(df, "viewer_executive_aggregate_only", "employee_id", ["department"]).collect()
    assert sorted(map(tuple, totals)) == [("Ops", 6, 60.0), ("Small", 2, None)]
    assert privacy.export(df, "project_manager", "employee_id", ["department"]).count() == 0
    assert privacy.export(df, "auditor_read_only", "employee_id", ["department"]).first().employee_name == "S.A. (E0)"


def test_gate_on_delivered_files(spark, tmp_path):
    for name in ("zk_attendance_logs_20260601.csv", "notes.txt"):
        (tmp_path / name).write_text("x" * 7)
    got = {r.file_name: (r.source_category, r.gate, r.bytes) for r in quality.gate_delivery(spark, str(tmp_path)).collect()}
    assert got == {"zk_attendance_logs_20260601.csv": ("Attendance", "Accept", 7), "notes.txt": (None, "Quarantine File", 7)}
