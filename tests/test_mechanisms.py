"""Tables written in part, searches, purges, protected tables and streams, against brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.operators import names, privacy, retention, suppression
from tallyhouse.operators.search import SearchIndex
from tallyhouse.operators.tables import KeyedTable, MonthTable, insert_missing, update_by_key
from tallyhouse.operators.temporal import working_days
from tallyhouse.session import scratch_dir
from tallyhouse.streaming.audit import AUDIT_SCHEMA, append_stream, audit_records

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# ------------------------------------------------------------ names in narratives
def redacted(spark, texts, people):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    master = spark.createDataFrame([(p,) for p in people], "name string")
    entities = frame.withColumn("text", privacy.redact_entities("text"))
    return [r.text for r in names.redact_people(entities, "text", master, "name").orderBy("id").collect()]


def test_declared_example(spark):
    text = "Disputed late deduction of 500 SAR with manager Khalid."
    assert redacted(spark, [text], ["Khalid Al-Harbi"]) == ["Disputed late deduction of [MONEY] with manager [PERSON]."]


def test_names_in_all_their_forms(spark):
    texts = [
        "Khalid Al-Harbi's and KHALID AL HARBI told Khalid, not khalid.",
        "Al said: Harbi",
        "Maria José de la Cruz Ortega wrote",
        "Zoë Zoë; Zoë. Ali",
        None, "", "…", "no one", "Khalid  Al-Harbi", "Khalid. Al-Harbi",
    ]
    got = redacted(spark, texts, ["Khalid Al-Harbi", "maria josé de la cruz ortega", "Zoë", "Ed", None, ""])
    assert got == [
        "[PERSON]'s and [PERSON] told [PERSON], not khalid.",
        "Al said: [PERSON]",
        "[PERSON] [PERSON] wrote",
        "[PERSON] [PERSON]; [PERSON]. Ali",
        None, "", "…", "no one", "[PERSON]", "[PERSON]. [PERSON]",
    ]


# ------------------------------------------------------------ keyed tables
def files_of(path: str, part: str) -> set[str]:
    return {str(p) for p in Path(path, part).glob("*.parquet")}


def test_insert_and_update_treat_null_as_a_key(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([(None, 9), ("b", 3), ("b", 3)], "k string, v int")
    assert sorted(insert_missing(old, new, ["k"]).collect(), key=str) == sorted([("a", 1), (None, 2), ("b", 3)], key=str)
    assert sorted(update_by_key(old, new.dropDuplicates(), ["k"]).collect(), key=str) == sorted([("a", 1), (None, 9)], key=str)


def test_keyed_table_rewrites_only_touched_buckets(spark):
    path = scratch_dir(spark, "keyed")
    table = KeyedTable(spark, path, ["k"], buckets=16)
    table.create(spark.range(200).select(F.col("id").alias("k"), F.lit("old").alias("s"), F.lit(1).alias("n")))
    before = {p.name: files_of(path, p.name) for p in Path(path).glob("_bucket=*")}
    changes = spark.createDataFrame([(3, "new", None), (None, "none", 5), (1000, "far", 7), (1000, "far", 7)], "k long, s string, n int")
    touched = table.insert(changes)
    assert table.insert(changes) == []
    want = {(k, "old", 1) for k in range(200)} | {(None, "none", 5), (1000, "far", 7)}
    assert Counter(map(tuple, table.read().collect())) == Counter(want)
    touched += table.update(changes.where("k = 3"))
    assert (3, "new", 1) in set(map(tuple, table.read().collect())) and table.read().count() == 202
    assert len(set(touched)) <= 3
    for part, files in before.items():
        same = files_of(path, part) == files
        assert same == (int(part.split("=")[1]) not in touched)


def test_month_table_corrects_only_its_months(spark):
    path = scratch_dir(spark, "months")
    table = MonthTable(spark, path, "month", "id")
    months = ["2024-01", "2024-02", "2024-03", "2024-04"]
    table.write(spark.createDataFrame([(m, i, "p", float(i)) for m in months for i in range(5)], "month string, id int, project string, pay double"))
    before = {m: files_of(path, f"month={m}") for m in months}
    changes = spark.createDataFrame([(2, "2024-03", "q", None), (2, "2024-04", None, 9.0), (77, "2024-01", "z", None)], "id int, from_month string, project string, pay double")
    assert table.correct(changes) == ["2024-03", "2024-04"]
    got = {(r.month, r.id): (r.project, r.pay) for r in table.read().collect()}
    want = {(m, i): ("p", float(i)) for m in months for i in range(5)} | {("2024-03", 2): ("q", 2.0), ("2024-04", 2): ("q", 9.0)}
    assert got == want
    assert [files_of(path, f"month={m}") == before[m] for m in months] == [True, True, False, False]
    table.write(spark.createDataFrame([("2024-02", 9, "r", 1.0)], "month string, id int, project string, pay double"))
    assert table.read().where("month = '2024-02'").count() == 1 and table.read().count() == 16


# ------------------------------------------------------------ search
def test_search_pages(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["North", "South", None]), " ".join(rng.choice(["Anna", "Banana", "ananas", "Zürich", "x"]) for _ in range(3))) for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, area string, note string").repartition(5)
    index = SearchIndex(spark, scratch_dir(spark, "search"), ["id"], ["area", "note"], block_rows=16, parts=8)
    index.build(frame)
    for needle in ("ANAN", "th ba", "zür", "x", "", "nowhere", "üri"):
        want = [r for r in rows if needle.lower() in " ".join(x for x in r[1:] if x is not None).lower()]
        got, after = [], None
        while page := index.page(needle, after, size=97).collect():
            got += map(tuple, page)
            after = (page[-1].id,)
        assert got == want
    plan = index.page("banana", (50,))._jdf.queryExecution().executedPlan().toString()
    assert "Offset" not in plan and "PartitionFilters: [part" in plan.replace("isnotnull(part#", "") or "part#" in plan


# ------------------------------------------------------------ purge
@pytest.mark.parametrize("form", ["yyyy-MM-dd", "yyyy-MM"])
def test_purge(spark, form):
    path, today = scratch_dir(spark, "retained"), date(2024, 6, 30)
    rows = [(i, f"u{i % 4}" if i % 9 else None, today - timedelta(days=i)) for i in range(150)]
    frame = spark.createDataFrame(rows, "id int, user string, day date").withColumn("period", F.date_format("day", form))
    frame.coalesce(1).write.partitionBy("period").parquet(path)
    holds = spark.createDataFrame([("u1",), (None,)], "user string").where("user IS NULL OR user <> ''")
    audit = retention.purge(spark, path, "period", 40, today, holds, "user").collect()
    end = (lambda d: d) if form == "yyyy-MM-dd" else (lambda d: (d.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1))
    want = [i for i, user, day in rows if (today - end(day)).days <= 40 or user == "u1"]
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == sorted(want)
    assert len(audit) == 1 and "dropped" in audit[0].reason_comment
    kept = {p.name for p in Path(path).glob("period=*")}
    assert retention.purge(spark, path, "period", 40, today, holds, "user").count() == 1
    assert {p.name for p in Path(path).glob("period=*")} == kept
    retention.purge(spark, path, "period", 40, today)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [i for i, _, day in rows if (today - end(day)).days <= 40]


# ------------------------------------------------------------ protected tables
def given_away(cells: list[tuple]) -> list[tuple]:
    """Hidden cells whose value every solution of the table's sums agrees on: cells are row, column, hidden."""
    hidden = [(r, c) for r, c, h in cells if h]
    place = {x: i for i, x in enumerate(hidden)}
    lines = {}
    for r, c, h in cells:
        for line, sign in ((("row", r), -1 if c == "all" else 1), (("column", c), -1 if r == "all" else 1)):
            row = lines.setdefault(line, np.zeros(len(hidden)))
            if h:
                row[place[r, c]] += sign
    system = np.array(list(lines.values()))
    rank = np.linalg.matrix_rank(system) if len(hidden) else 0
    return [x for x, i in place.items() if np.linalg.matrix_rank(np.vstack([system, np.eye(len(hidden))[i]])) == rank]


@SLOW
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 4))), st.integers(1, 12), min_size=1, max_size=20))
def test_no_hidden_cell_follows_from_the_others(spark, sizes):
    rows = [(r, c, 10.0 * r + i) for (r, c), n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "a int, b int, v double")
    found = suppression.protected_table(frame, "a", "b", F.sum("v"), "v").collect()
    assert len(found) == len(sizes) + len({r for r, _ in sizes}) + len({c for _, c in sizes}) + 1
    cells = [("all" if x.a_total else x.a, "all" if x.b_total else x.b, x.v is None) for x in found]
    assert all((x.v is None) == (x.state != "shown") for x in found) and all(x.v is None for x in found if x.group_size < 5)
    # A table of one cell has no rectangle apart from its totals, which are the same group.
    assert given_away(cells) == []


# ------------------------------------------------------------ audit stream
def test_replayed_events_are_appended_once(spark):
    feed, out, state = (scratch_dir(spark, p) for p in ("feed", "out", "state"))

    def deliver(ids):
        frame = spark.createDataFrame([(i, datetime(2020 + (int(i or 0) % 5), 1, 1)) for i in ids], "event_id string, ts timestamp_ntz")
        audit_records(frame, event_id=F.col("event_id"), timestamp=F.col("ts"), action_type=F.lit("dashboard_view")).write.mode("append").parquet(feed)
        append_stream(spark.readStream.schema(AUDIT_SCHEMA).parquet(feed), out, state).awaitTermination()

    deliver(["1", "2", "2", None])
    deliver(["2", "3", "1", None])  # a replay, an old event that comes late, one without an id
    deliver(["4", "3"])
    got = Counter(r.event_id for r in spark.read.parquet(out).collect())
    assert got == Counter({"1": 1, "2": 1, "3": 1, "4": 1, None: 2})


# ------------------------------------------------------------ calendars
DAYS = st.integers(-800, 20_000).map(lambda n: date(1970, 1, 1) + timedelta(days=n))


@SLOW
@given(st.lists(st.tuples(DAYS, st.integers(-3, 60)), min_size=1, max_size=10), st.sets(st.sampled_from(["Friday", "Saturday", "Sunday", "Monday", "Thursday"])))
def test_working_days_by_arithmetic(spark, spans, weekend):
    rows = [(i, s, s + timedelta(days=n)) for i, (s, n) in enumerate(spans)]
    frame = spark.createDataFrame(rows, "i int, s date, e date")
    got = {r.i: r.n for r in frame.select("i", working_days(F.col("s"), F.col("e"), sorted(weekend)).alias("n")).collect()}
    for i, s, e in rows:
        days = [s + timedelta(days=k) for k in range((e - s).days + 1)]
        assert got[i] == sum(d.strftime("%A") not in weekend for d in days)


# ------------------------------------------------------------ incremental intake
class Jobs:
    """Counts the files opened by scans through the listed leaf paths of executed reads."""

    def __init__(self, monkeypatch, intake):
        self.parsed, self.hashed = [], []
        lines, contents = intake._lines, intake._contents
        monkeypatch.setattr(intake, "_lines", lambda s, path, *a, **k: (self.parsed.append(path), lines(s, path, *a, **k))[1])
        monkeypatch.setattr(intake, "_contents", lambda s, paths: (self.hashed.append(paths), contents(s, paths))[1])

    def taken(self):
        out = [sorted(p.rsplit("/", 1)[-1] for paths in found for p in paths) for found in (self.parsed, self.hashed)]
        self.parsed.clear(), self.hashed.clear()
        return out


def test_only_new_and_changed_files_are_read(spark, tmp_path, monkeypatch):
    import os

    from tallyhouse.sources import intake
    from tallyhouse.sources.schemas import columns

    names = [c for c, _ in columns("vacancy_requests")]
    folder = tmp_path / "vacancy_requests.csv"
    folder.mkdir()

    def put(file, *rows):
        lines = [",".join(names), *[",".join([i, "D", "P", "J", q, "Approved", "2024-01-01"][: len(names)]) for i, q in rows]]
        (folder / file).write_text("\n".join(lines) + "\n")

    bronze, silver, jobs = f"{tmp_path}/b", f"{tmp_path}/s", Jobs(monkeypatch, intake)
    load = lambda: intake.refresh_table(spark, "vacancy_requests", str(folder), bronze, silver)
    rows = lambda: sorted((r.request_id, r.quantity) for r in intake.read_typed(spark, silver, "vacancy_requests").collect())
    put("a.csv", ("V1", "1"), ("V2", "x"))
    put("b.csv", ("V3", "3"))
    assert all(t[-1] for t in load()) and jobs.taken() == [["a.csv", "b.csv"], ["a.csv", "b.csv"]]
    assert rows() == [("V1", 1), ("V2", None), ("V3", 3)]
    assert load() == [] and jobs.taken() == [[], []]
    os.utime(folder / "a.csv", (1, 1))
    assert load() == [] and jobs.taken() == [[], ["a.csv"]]
    assert load() == [] and jobs.taken() == [[], []]
    put("b.csv", ("V3", "30"))
    put("c.csv", ("V4", "4"))
    assert load() and jobs.taken() == [["b.csv", "c.csv"], ["b.csv", "c.csv"]]
    assert rows() == [("V1", 1), ("V2", None), ("V3", 30), ("V4", 4)]
    (folder / "a.csv").unlink()
    assert load() and jobs.taken() == [[], []] and rows() == [("V3", 30), ("V4", 4)]


def test_totals_are_counted_while_writing(spark, tmp_path):
    from tallyhouse.sources import intake

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.range(10).select(F.col("id").cast("double").alias("pay"))
    frame = frame.mapInArrow(counted, frame.schema)
    got = intake.observed(frame, intake.control_totals([("pay", "double")], ["pay"], typed=True), lambda df: df.write.parquet(f"{tmp_path}/t"))
    assert got == {"rows": 10, "pay values": 10, "pay sum": "45.000000"}
    assert read.value == 10  # every row passed once


def test_one_id_of_very_many_names(spark):
    from tallyhouse.plans.all import Warehouse
    from tests.people_fixture import tables

    own = tables(spark)
    base = own["employees"].limit(1)
    many = base.drop("employee_id", "employee_name").crossJoin(spark.range(100_000)).withColumn("employee_id", F.lit("E-many")).withColumn("employee_name", F.concat(F.lit("Name "), "id"))
    wh = Warehouse(spark, own | {"employees": own["employees"].unionByName(many.select(own["employees"].columns))})
    found = wh.view("data_quality").where("issue_type = 'Duplicate Employee ID' AND entity_id = 'E-many'")
    assert found.agg(F.count_distinct("entity_name"), F.count("*")).first()[:] == (100_000, 100_000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
