"""Embedding links, resharding and the pipeline against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tallyhouse.llm import embedding_graph, reshard
from tallyhouse.session import pin, scratch_dir
from tests.conftest import SMALL
from tests.llm.conftest import hard_rows
from tests.llm.test_texts import contaminated, jaccard_links

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    good = [(i, np.array(e, dtype=float), label) for i, e, label in rows if e and label is not None and None not in e and np.isfinite(np.array(e, dtype=float)).all() and any(e)]
    root, n = {r[0]: r[0] for r in rows}, defaultdict(int)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(good)):
        for b in range(a):
            (i, x, p), (j, y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {r[0]: (n[r[0]], top(r[0])) for r in rows}


@pytest.mark.parametrize("block, shard", [(2048, 1000), (15, 1000), (2048, 40)])
def test_embedding_links(llm, monkeypatch, block, shard):
    monkeypatch.setattr(embedding_graph, "BLOCK", block)
    monkeypatch.setattr(embedding_graph, "SHARD", shard)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + rng.normal(scale=0.1, size=16)).astype(np.float32).tolist(), i % 2) for i in range(200)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(5)] + [(310 + i, rows[0][1], 0) for i in range(6)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(400 + i, v, 0) for i, v in enumerate(odd)] + [(500, rows[0][1], None)]
    frame = llm.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS size", "2 AS home").repartition(3)
    found, usable = embedding_graph.links(frame)
    got, want = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}, brute(rows)
    assert got.keys() == want.keys()
    links = sum(n for n, _ in want.values())
    assert links > 200 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * links
    if (block, shard) != (2048, 40):  # one shard a label: nothing can be missed at a border
        assert got == want
    assert embedding_graph.audit(usable, found) >= 0.9


def test_no_embeddings(llm):
    found, usable = embedding_graph.links(llm.createDataFrame([], VECTORS))
    assert found.count() == 0 and embedding_graph.audit(usable, found) == 1.0


def test_flow_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m = map(int, rng.integers(1, 5, 2))
        supply, cost = rng.integers(0, 20, n).tolist(), rng.integers(0, 5, (n, m))
        demand = reshard.even(sum(supply), m)
        flow = reshard.min_cost_flow(supply, demand, cost)
        assert flow.sum(axis=1).tolist() == supply and flow.sum(axis=0).tolist() == demand and (flow >= 0).all()
        # Cheapest: no cycle of the residual graph has a negative cost.
        far = np.full((n + m, n + m), 1e9)
        far[:n, n:] = cost
        far[n:, :n] = np.where(flow > 0, -cost, 1e9).T
        for k in range(n + m):
            far = np.minimum(far, far[:, [k]] + far[[k], :])
        assert (np.diag(far) >= 0).all()


def test_levels():
    assert reshard.levels([5, 1, 3], 6) == [0, 4, 2]
    assert reshard.levels([0, 0], 3) in ([2, 1], [1, 2])
    assert reshard.levels([9, 0], 4) == [0, 4]


def test_reshard(llm, hard, nothing):
    documents = hard.drop("shard").selectExpr("*", "CAST(doc_id % 3 AS INT) AS old")
    moved, changed = reshard.reshard(documents, "old", 5)
    path = scratch_dir(llm, "t")
    reshard.rewrite(moved, changed, path)
    rows = reshard.read_shards(llm, path, moved.schema).unionByName(moved.where(~moved["_shard"].isin(changed))).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(((r[0], r[1]) for r in hard_rows()), key=repr)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r._shard].append(r._slot)
        sizes[r._shard] += r._size
        assert r._size == len((r.text or "").encode()) + 16
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(r._size for r in rows)
    empty, changed = reshard.reshard(nothing.drop("shard").selectExpr("*", "1 AS old"), "old", 5)
    assert empty.count() == 0 and changed == []


def test_what_fits_stays(llm):
    rows = llm.createDataFrame([(i, "x" * 84, i % 4) for i in range(400)], "doc_id long, text string, old int")
    moved, changed = reshard.reshard(rows, "old", 4)
    assert changed == [] and moved.where("_shard <> old").count() == 0
    more, changed = reshard.reshard(rows, "old", 5)
    assert more.where("_shard <> old").count() == 80 and changed == [0, 1, 2, 3, 4]


def test_no_byte_moves_between_even_shards(llm):
    large = [(i, "x" * 984, 0) for i in range(10)]
    rows = llm.createDataFrame(large + [(100 + i, "y" * 84, 1) for i in range(100)], "doc_id long, text string, old int")
    moved, changed = reshard.reshard(rows, "old", 2)
    assert changed == [] and moved.where("_shard <> old").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_little_more_than_the_surplus_moves(llm, seed):
    rng = np.random.default_rng(seed)
    docs = [(i, "x" * int(rng.pareto(1.2) * 200 % 20_000), int(min(rng.geometric(0.4), 9)) - 1) for i in range(600)]
    moved, _ = reshard.reshard(llm.createDataFrame(docs, "doc_id long, text string, old int"), "old", 12)
    rows = moved.collect()
    total, old = sum(r._size for r in rows), defaultdict(int)
    for r in rows:
        old[r._old] += r._size
    needed = sum(max(0, b - total // 12) for b in old.values())
    new = defaultdict(int)
    for r in rows:
        new[r._shard] += r._size
    most = max(r._size for r in rows)
    assert sum(r._size for r in rows if r._old != r._shard) <= needed + 12 * most
    assert max(new.values()) - min(new.values()) <= most


def test_pipeline_stages(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "ngram_jaccard", "decontaminate", "best_two_fit"]
    kept = pin(stages["language_id"](llm, docs, SMALL))
    assert kept.columns == columns and kept.count() >= 0.98 * docs.count()
    lines = pin(stages["line_dedup"](llm, kept, SMALL))
    blank, lower = " \t\n\x0b\x0c\r", lambda s: s.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    docs_of, seen, want = defaultdict(set), set(), {}
    for r in kept.collect():
        for line in r.text.split("\n"):
            docs_of[lower(line.strip(blank))].add(r.doc_id)

    def stays(line):
        key = lower(line.strip(blank))
        first = key not in seen
        seen.add(key)
        return not key or first or len(docs_of[key]) < 10

    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        left = [line for line in r.text.split("\n") if stays(line)]
        if len(left) == r.text.count("\n") + 1 or "".join(left).strip(blank):
            want[r.doc_id] = "\n".join(left)
    got = lines.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got) and lines.columns == columns
    single = pin(stages["ngram_jaccard"](llm, lines, SMALL))
    classes = jaccard_links([(r.doc_id, r.text) for r in got])
    assert {r.doc_id for r in single.collect()} == {c for c, _ in classes.values()} and single.columns == columns
    clean = pin(stages["decontaminate"](llm, single, SMALL))
    items = [(r.item_id, r.text) for r in llm.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    judged = contaminated([(r.doc_id, r.text) for r in single.collect()], items, 10)
    assert {r.doc_id for r in clean.collect()} == {d for d, _, hit, _ in judged if not hit} and clean.columns == columns
    assert clean.count() < single.count() < docs.count()
    packed = stages["best_two_fit"](llm, clean, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in clean.collect()}
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(llm, SMALL).collect()) == sorted(tuple(r)[:5] for r in packed)


def test_pipeline_on_hard_and_empty_rows(llm, hard, nothing):
    clashing = hard.selectExpr("*", *[f"doc_id * 2 AS {c}" for c in ("n_dropped", "_id", "_row", "_hash", "certainty", "n_words", "keep_words", "class_id")])
    for docs in (clashing, nothing):
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, pin(stage(llm, docs, SMALL))
            if name != "best_two_fit":
                assert docs.columns == before
                assert "_row" not in before or docs.where("NOT (_row <=> doc_id * 2 AND certainty <=> doc_id * 2 AND score <=> 1)").count() == 0
        assert docs.columns[0] == "doc_id"


def test_line_stage_keeps_one_of_many_copies(llm):
    text = "First line of a page.\nSecond line of it.\n\nThird line."
    near = [f"{text}\nown {i}" for i in range(12)]
    rows = [(i, t) for i, t in enumerate([text] * 12 + near)] + [(50 + i, "Third line.\n" + " ".join(f"word{i}x{k}" for k in range(20))) for i in range(3)]
    docs = llm.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](llm, docs.unionByName(docs.where("doc_id = 0")).repartition(4), SMALL).collect()}
    assert got[0].text == text and got[0].n_chars == len(text)
    assert not set(range(1, 12)) & set(got)
    assert all(got[12 + i].text == f"\nown {i}" for i in range(12))
    assert all("Third" not in got[50 + i].text for i in range(3))


def test_language_stage_keeps_texts_of_many_languages(llm):
    docs, stage = llm.read.parquet(f"{SMALL}/documents.parquet"), dict(corpus_pipeline.STAGES)["language_id"]
    parts = [r.text.split()[:30] for lang in ("de", "en", "es", "fr") for r in docs.where(f"lang = '{lang}' AND n_chars > 300").orderBy("doc_id").limit(1).collect()]
    assert len(parts) >= 3
    texts = [" ".join(w for p in chosen for w in p) for chosen in (parts[:3], parts)]
    rows = [(10**6 + i, t, None, None, len(t)) for i, t in enumerate([*texts, "12 34"])]
    more = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(docs.columns)
    kept = {r.doc_id for r in stage(llm, docs.unionByName(more), SMALL).collect()}
    assert {10**6, 10**6 + 1} <= kept and 10**6 + 2 not in kept
    assert {r.doc_id for r in docs.collect()} <= kept
    assert {r.doc_id for r in stage(llm, more, SMALL).collect()} == {10**6, 10**6 + 1}


def test_jaccard_stage_tells_texts_of_one_id_apart(llm):
    own = ["one two three four five six", "seven eight nine ten eleven twelve", "red green blue white black grey", "a b c d e f g h"]
    rows = [(1, own[0]), (1, own[1]), (1, own[1]), (5, own[1]), (None, own[2]), (None, own[2]), (None, own[3]), (None, own[0]), (9, own[3]), (None, None), (None, "?!")]
    docs = llm.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard"](llm, docs, SMALL).collect()
    want = [(1, own[0]), (1, own[1]), (None, own[2]), (9, own[3]), (None, None), (None, "?!")]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(want, key=repr)
