"""Decontamination, lines, passages, near copies and languages against brute force."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyhouse.llm import components as components_module
from tallyhouse.llm import decontaminate, language_crf, line_dedup, minhash_forest, suffix_dedup
from tallyhouse.llm.components import components, joined
from tallyhouse.llm.queries import ORACLE_SQL, QUERIES
from tallyhouse.llm.suffix_array import suffix_array
from tallyhouse.session import pin
from tests.conftest import SMALL
from tests.llm.conftest import hard_rows, sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def rows_sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_checking_sql(llm, duck, name):
    got = QUERIES[name](llm, SMALL)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())


def contaminated(rows, items, window):
    theirs = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        n = min(len(w), window)
        for s in range(len(w) - n + 1 if w else 0):
            theirs[tuple(w[s : s + n])].add("" if item_id is None else str(item_id))
    out = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in theirs}:
            for s in range(len(w) - n + 1):
                if (found := theirs.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    ids |= found
        out.append((doc_id, len(w), len(hit), sorted(ids)))
    return out


def test_decontamination(llm, hard, nothing):
    base = [r[1] for r in hard_rows()[:12]]
    items = [(1, base[0][10:200]), (2, "SEVEN " + base[1][:120]), (3, "stone cloud"), (4, "über"), (5, None), (6, "?!"), (None, base[2]), (7, base[0][10:200]), (11, "12 34"), (12, "Été à l'eau")]
    benchmark = llm.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS words", "2 AS mark", "3 AS item")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(hard, benchmark).collect()]
    want = contaminated([r[:2] for r in hard_rows()], items, 10)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r.n_hit for r in decontaminate.contamination(hard, benchmark.where("false")).collect()} == {0}
    assert decontaminate.contamination(nothing, benchmark).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_every_shared_window_is_found(llm, seed):
    """Few words and many repeats: windows that overlap, touch and recur."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    docs, items = [(i, text(rng.randint(0, 60))) for i in range(30)], [(i, text(rng.randint(1, 14))) for i in range(8)]
    got = decontaminate.contamination(llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(items, "item_id long, text string"), window=6, gram=3)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == sorted(contaminated(docs, items, 6))
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans or []) == r.n_hit


def test_lines(llm, hard, nothing):
    rows, blank = hard_rows(), " \t\n\x0b\x0c\r"
    docs_of = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            docs_of[line.strip(blank).translate(LOWER)].add(doc_id)
    want = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (k := x.strip(blank).translate(LOWER)) or len(docs_of[k]) < 10]
        want.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.with_bitmaps(hard)
    got = found.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text(found["text"], found["keep_words"])).collect()
    assert rows_sorted(map(tuple, got)) == rows_sorted(want)
    assert sum(r[2] for r in want) > 0
    assert line_dedup.with_bitmaps(nothing).count() == 0


def test_bitmaps_of_many_lines(llm):
    text = "\n".join("x" if i % 3 else f"own {i}" for i in range(200))
    docs = llm.createDataFrame([(i, text + f"\n{i}") for i in range(10)], "doc_id long, text string")
    got = line_dedup.with_bitmaps(docs)
    for r in got.select("doc_id", "n_dropped", line_dedup.kept_text(got["text"], got["keep_words"]).alias("kept")).collect():
        assert r.n_dropped == 200 and r.kept == str(r.doc_id)  # the numbered lines are in all ten too


def removed(rows, length):
    seen, out = {}, {}
    for doc_id, raw in rows:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if seen.setdefault(raw[s : s + length], (doc_id, s)) != (doc_id, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[doc_id] = (len(raw), len(raw) - len(kept), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


def test_greek_endings_are_folded_like_their_windows(llm):
    docs = llm.createDataFrame([(1, "ΟΔΟΣ.Α " * 5), (2, "nothing")], "doc_id long, text string")
    items = llm.createDataFrame([(7, "ΟΔΟΣ Α " * 5)], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: 10, 2: 0}


@pytest.mark.parametrize("chunk", [16384, 2])
def test_passages(llm, hard, nothing, chunk):
    rows = {r[0]: r[1] for r in hard_rows()}
    rows[None] = next(r[1] for r in hard_rows() if r[0] is None)
    ordered = sorted(rows.items(), key=lambda r: (r[0] is not None, r[0] or 0))
    want = removed([(k, (v or "").encode()) for k, v in ordered], 100)
    got = suffix_dedup.deduplicated(hard.where("NOT (doc_id IS NULL AND text IS NULL)"), chunk=chunk).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == {(k, *v) for k, v in want.items()}
    assert len(got) == len(hard_rows()) - 1
    assert suffix_dedup.deduplicated(nothing).count() == 0


def test_texts_of_one_id_are_told_apart(llm):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared, twice = word(300), word(300)
    rows = [(5, word(200) + shared + word(100)), (5, word(900)), (1, word(50) + shared), (None, twice + word(80)), (None, word(90) + twice), (7, word(150)), (7, word(150))]
    rows.append(rows[2])
    frame = llm.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept_sha256) for r in suffix_dedup.deduplicated(frame).collect()}
    assert got[5, 600][0] == 300 and got[5, 900][0] == 0 and got[1, 350][0] == 0
    assert sorted(got[None, n][0] for n in (380, 390)) == [0, 300]
    assert got[5, 900][1] == hashlib.sha256(rows[1][1].encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_few_letters(llm, seed):
    rng = random.Random(seed)
    part = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(3)]
    docs = [(i, "".join(rng.choice([*part, "ab" * 20, "é", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(25)]
    got = suffix_dedup.deduplicated(llm.createDataFrame(docs, "doc_id long, text string"), length=20, gram=6, chunk=3 if seed else 16384, with_kept=True).collect()
    want = removed([(i, t.encode()) for i, t in docs], 20)
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got} == want
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_long_text_in_segments(llm, monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef") for _ in range(3000))
    raw = np.frombuffer((text + text[500:900]).encode(), dtype=np.uint8)
    whole = suffix_dedup._anchors(raw, np.array([0, len(raw)]), 30, 8)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 256)
    assert len(whole[0]) > 0
    docs = llm.createDataFrame([(1, text + text[500:900])], "doc_id long, text string")
    (r,) = suffix_dedup.deduplicated(docs, length=30, gram=8).collect()
    assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == removed([(1, (text + text[500:900]).encode())], 30)[1]


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text = np.concatenate([np.append(rng.integers(1, rng.choice([2, 3, 200]) + 1, rng.integers(1, 40)), 0) for _ in range(rng.integers(1, 6))]).astype(np.uint8)
        raw, found = text.tobytes(), suffix_array(text, 400)
        assert sorted(found) == list(range(len(raw)))
        assert list(found) == sorted(range(len(raw)), key=lambda i: raw[i:])


def jaccard_links(rows):
    sets = {}
    for doc_id, text in rows:
        w = words(text)
        if w:
            sets[doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
    root, n = {d: d for d, _ in rows}, Counter()

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                n[a] += 1
                n[b] += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (top(d), n[d]) for d, _ in rows}


@pytest.mark.parametrize("block", [512, 3])
def test_near_copies(llm, nothing, monkeypatch, block):
    monkeypatch.setattr(minhash_forest, "BLOCK", block)
    rng = random.Random(8)
    base = [sentence(rng, 80).split() for _ in range(6)]
    rows = []
    for i in range(60):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(["new", "odd"])
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(100, None), (101, ""), (102, "?!"), (103, "one two"), (104, "One, two."), (105, "one three")]
    frame = llm.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS k1", "3 AS rep")
    got = minhash_forest.links(frame).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == jaccard_links(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got) and len(got) == len(rows)
    assert minhash_forest.links(nothing).count() == 0


def test_near_copies_of_hard_rows(hard):
    got = minhash_forest.links(hard).collect()
    assert len(got) == len(hard_rows())
    assert all(r.class_id is None and r.n_links == 0 for r in got if r.doc_id is None)


def test_prefixes_are_shortened_to_the_target():
    assert minhash_forest.stop_depth(0.8, 0.999) == 5
    assert minhash_forest.stop_depth(0.8, 0.5) == 8
    assert minhash_forest.stop_depth(0.1, 0.999) == 1
    nothing_found, low, high = np.zeros(20, int), np.zeros(20, int), np.zeros(20, int)
    low[0], high[18] = 10_000, 10_000
    for depth in (8, 7, 6, 5):
        worst = 1 - (1 - 0.8**depth) ** 20
        assert abs(minhash_forest.estimated_recall(nothing_found, 0.8, depth) - worst) < 1e-9
        assert abs(minhash_forest.estimated_recall(low, 0.8, depth) - worst) < 1e-4
        assert minhash_forest.estimated_recall(high, 0.8, depth) > 0.9999


def sorted_classes(llm, rows):
    frame = llm.createDataFrame(rows, "doc_id long, text string")
    sketched = minhash_forest.sketches(frame, 5, 20, 8).where("n > 0")
    return frame, pin(sketched.selectExpr("k1", "k2", "doc_id AS rep", "text_hash AS rep_hash", "1L AS size", "n", "labels"))


def test_tries_hold_all_labels_with_a_near_neighbour(llm):
    rng = random.Random(4)
    base = sentence(rng, 120).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else f"odd{i}" for w in base)) for i in range(40)] + [(i, sentence(rng, 50)) for i in range(40, 90)]
    _, classes = sorted_classes(llm, rows)
    labels = [(r.rep, bytes(x)) for r in classes.collect() for x in r.labels]
    assert len(labels) == 90 * 20 and {x[:2] for _, x in labels} == {i.to_bytes(2, "big") for i in range(20)}
    trie = pin(minhash_forest.tries(classes.repartition(4), 8, 3))
    kept = {(r.rep, bytes(r.label)): r.shared for r in trie.collect()}
    for depth in (3, 5, 8):
        runs = defaultdict(set)
        for rep, x in labels:
            runs[x[: 2 * (depth + 1)]].add(rep)
        assert all(kept[rep, x] >= depth for rep, x in labels if len(runs[x[: 2 * (depth + 1)]]) > 1)
        root = {rep: rep for rep in range(90)}
        for run in runs.values():
            joined = {root[x] for x in run}
            root = {x: min(joined) if r in joined else r for x, r in root.items()}
        got = {r.rep: r.g for r in minhash_forest._groups(trie, depth).collect()}
        assert got == {x: r for x, r in root.items() if list(root.values()).count(r) > 1}


def test_a_lower_target_stops_at_longer_prefixes(llm):
    """Many pairs close to the threshold: the depth follows the target, and the estimate holds against brute force."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        near = list(words)
        for at in rng.sample(range(200), 4):
            near[at] = "other"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    true = {(2 * i, 2 * i + 1) for i in range(400) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    frame, classes = sorted_classes(llm, rows)
    depths, found = [], []
    for recall in (0.9, 0.97, 0.999):
        verified, depth = minhash_forest.search(frame, classes, 5, 0.8, recall, 20)
        pairs = {(r.root, r.rep) for r in verified.collect() if r.rep != r.root}
        assert pairs <= true and len(pairs) >= (recall - 0.03) * len(true)
        depths.append(depth)
        found.append(len(pairs))
    assert depths == sorted(depths, reverse=True) and depths[0] > depths[-1] and found == sorted(found)
    assert found[-1] >= 0.99 * len(true) > 100


def test_components(llm):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(50, 90)] + [(7, i) for i in range(100, 140)] + [(rng.randint(200, 240), rng.randint(200, 240)) for _ in range(25)] + [(1, 1), (None, 3)]
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = components(llm.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == root and len(got) == len(root)
    assert components(llm.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("chunk", [3, 1 << 20])
def test_joined_components_are_those_of_all_edges(llm, request, monkeypatch, chunk):
    """Small chunks leave paths and need rounds; in one chunk all is hung at once."""
    monkeypatch.setattr(components_module, "CHUNK", chunk)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    request.addfinalizer(functools.partial(llm.conf.set, size, llm.conf.get(size)))
    llm.conf.set(size, str(min(chunk, 10_000)))
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(300, 420)] + [(7, i) for i in range(100, 160)] + [(rng.randint(500, 700), rng.randint(500, 700)) for _ in range(150)] + [(1, 1), (None, 3), (4, None)]
    rng.shuffle(edges)
    frame = llm.createDataFrame(edges, "u long, v long").repartition(5)
    want = {r.node: r.component for r in components(frame).collect()}
    got = joined(frame).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want) > 300
    assert joined(frame.where("false")).count() == 0


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_graphs_side_by_side_are_joined_apart(llm, request, monkeypatch, chunk):
    monkeypatch.setattr(components_module, "CHUNK", chunk)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    request.addfinalizer(functools.partial(llm.conf.set, size, llm.conf.get(size)))
    llm.conf.set(size, str(min(chunk, 10_000)))
    rng = random.Random(9)
    edges = [(k, rng.randint(0, 60), rng.randint(0, 60)) for k, n in ((5, 60), (6, 30), (7, 10)) for _ in range(n)] + [(8, i, i + 1) for i in range(20)] + [(5, None, 1)]
    frame = llm.createDataFrame(edges, "depth int, u long, v long").repartition(4)
    want = {(k, r.node): r.component for k in (5, 6, 7, 8) for r in components(frame.where(f"depth = {k}").drop("depth")).collect()}
    for found in (components(frame, "depth"), joined(frame, "depth")):
        got = found.collect()
        assert {(r.depth, r.node): r.component for r in got} == want and len(got) == len(want)
    assert joined(frame.where("false"), "depth").count() == 0


def test_torn_stars_are_joined_without_rounds(llm, request, monkeypatch):
    """Nodes that hang on several roots join these; the rounds over all edges are not needed."""
    monkeypatch.setattr(components_module, "CHUNK", 1)
    monkeypatch.setattr(components_module, "components", None)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    request.addfinalizer(functools.partial(llm.conf.set, size, llm.conf.get(size)))
    llm.conf.set(size, "1")
    frame = llm.createDataFrame([(i, root) for i in range(100, 120) for root in (1, 2, 3)], "u long, v long")
    assert {r.node: r.component for r in joined(frame).collect()} == dict.fromkeys([1, 2, 3, *range(100, 120)], 1)


def test_a_further_level_stores_one_table(llm, monkeypatch):
    """Groups of all levels are made at once; a level adds its verified links only."""
    rng = random.Random(6)
    rows = []
    for i in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        near = list(words)
        for at in rng.sample(range(200), 4):
            near[at] = "other"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    frame, classes = sorted_classes(llm, rows)
    stored = []

    def counted(df):
        stored[-1] += 1
        return pin(df)

    for module in (minhash_forest, components_module):
        monkeypatch.setattr(module, "pin", counted)
    depths = []
    for recall in (0.9, 0.999):
        stored.append(0)
        # The same trie for both targets.
        monkeypatch.setattr(minhash_forest, "stop_depth", lambda *_: 5)
        depths.append(minhash_forest.search(frame, classes, 5, 0.8, recall, 20)[1])
    assert depths[0] > depths[1] and stored[1] - stored[0] == depths[0] - depths[1]


def test_marginals_are_those_of_forward_backward():
    rng, k = np.random.default_rng(0), 3
    transitions, lengths = rng.normal(size=(k, k)), np.array([1, 5, 130, 64, 65, 2])
    scores = rng.random((lengths.sum(), k))
    got, at, step = language_crf.marginals(scores, lengths, transitions), 0, np.exp(transitions)
    for n in lengths:
        own, forward, backward, belief = scores[at : at + n], np.zeros((n, k)), np.ones((n, k)), np.ones(k)
        for t in range(n):
            belief = (belief @ step) * own[t]
            belief /= belief.sum()
            forward[t] = belief
        for t in range(n - 2, -1, -1):
            backward[t] = step @ (own[t + 1] * backward[t + 1])
            backward[t] /= backward[t].sum()
        both = forward * backward
        assert np.allclose(got[at : at + n], both / both.sum(axis=1, keepdims=True))
        at += n


@pytest.fixture(scope="module")
def model(llm):
    docs = llm.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language_crf.fit(language_crf.training_sample(docs))


def test_held_out_accuracy(model):
    docs, fitted = model
    got = {r.doc_id: r for r in language_crf.predict(docs, fitted).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 200
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)


def test_switches_and_odd_texts(llm, model):
    docs, fitted = model
    of = {lang: " ".join(docs.where(f"lang = '{lang}' AND n_chars > 300").orderBy("doc_id").first().text.split()[:40]) for lang in ("de", "fr")}
    rows = [(1, f"{of['de']} {of['fr']}"), (2, None), (3, ""), (4, "12 ² 34"), (5, of["fr"] * 50)]
    got = {r.doc_id: r for r in language_crf.predict(llm.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score"), fitted).collect()}
    assert 1 <= got[1].n_switches <= 6 and 0.3 < got[1].score < 0.8
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2, 3, 4))
    assert got[5].lang_pred == "fr" and got[5].score <= 1


def test_languages_of_hard_rows(hard, nothing):
    assert language_crf.identify(hard).count() == len(hard_rows())
    unlabelled = hard.withColumn("lang", hard["lang"].substr(5, 1).try_cast("int").cast("string"))
    assert {r.lang_pred for r in language_crf.identify(unlabelled).collect()} == {"und"}
    assert language_crf.identify(nothing).count() == 0


def test_letters_are_told_at_every_length(llm, model):
    docs, fitted = model
    fr = " ".join(docs.where("lang = 'fr' AND n_chars > 300").orderBy("doc_id").first().text.split()[:40])
    rows = [(1, "² " * 20), (2, "² " * 21), (3, "²½①" * 30), (4, fr), (5, fr + " ²" * 50)]
    got = {r.doc_id: r for r in language_crf.predict(llm.createDataFrame(rows, "doc_id long, text string"), fitted).collect()}
    assert all((got[i].lang_pred, got[i].score, got[i].n_words) == ("und", 0.0, 0) for i in (1, 2, 3))
    assert tuple(got[4])[1:] == tuple(got[5])[1:] and got[4].lang_pred == "fr"


def test_all_letters_of_a_long_run_count(llm, model):
    docs, fitted = model
    run = {lang: "".join(c for c in docs.where(f"lang = '{lang}' AND n_chars > 600").orderBy("doc_id").first().text.lower() if c.isalpha())[:400] for lang in ("de", "fr")}
    assert "".join(language_crf.words_of(run["de"])) == run["de"]
    rows = [(1, run["de"][:12] + run["fr"] + run["de"][-12:]), (2, run["de"][:12] + run["de"] + run["de"][-12:])]
    got = {r.doc_id: r for r in language_crf.predict(llm.createDataFrame(rows, "doc_id long, text string"), fitted).collect()}
    assert (got[1].lang_pred, got[2].lang_pred) == ("fr", "de") and got[1].n_words > 10


def test_lines_are_hashed_once(llm):
    """Dealing by range reads its rows twice; what it reads are stored hashes, not texts."""
    docs = llm.createDataFrame([(i, "a\nb") for i in range(12)], "doc_id long, text string")
    found = line_dedup.frequent_keys(docs)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert found.count() == 2
