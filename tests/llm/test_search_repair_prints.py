"""Lexical search, conversation repair and piecewise fingerprints against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import automaton_search, conversation_repair, piecewise_hash, queries
from tests.llm.conftest import hard_rows, sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").translate(UPPER))


def ranked(documents: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    bags = [(d, Counter(terms(t)), len(terms(t))) for d, t in documents]
    n_docs, n_terms = sum(n > 0 for *_, n in bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item_id, text in items:
        found = []
        for d, bag, n in bags:
            if n:
                m = 100 - 25 + (25 * n * n_docs) // n_terms
                score = sum(
                    r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
                    for t, r in Counter(terms(text)).items()
                    if bag[t]
                )
                if score > 0:
                    found.append((-score, d is None, d or 0, d))
        out += [(item_id, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


ITEMS = [(1, "The River, the stone; river CLOUD été x"), (2, None), (3, ""), (None, "light ÜBER über naïve"), (1, "own 3 same line"), (4, "nowhere-to-be-found"), (5, "x" * 500), (6, "12 34")]


def plain(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("block_bytes", [automaton_search.BLOCK_BYTES, 100])
def test_search(llm, hard, monkeypatch, block_bytes):
    items = llm.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS rank", "2 AS doc_id", "3 AS score")
    got = automaton_search.search(llm, hard, items, block_bytes=block_bytes).collect()
    assert plain(got) == plain(ranked([r[:2] for r in hard_rows()], ITEMS))


def test_search_of_nothing(llm, hard, nothing):
    items = llm.createDataFrame(ITEMS, "item_id long, text string")
    assert automaton_search.search(llm, nothing, items).count() == 0
    found = automaton_search.search(llm, hard, items.where("false"))
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbΣσ0 -,\n\t\xa0½_|日"), max_size=80), st.integers(1, 20))
def test_occurrences_are_those_of_whole_terms(text, size):
    wanted = ("a", "ab", "b", "0", "σ", "日a", "aa")
    marked, before = automaton_search.folded(text), automaton_search.CHUNK
    automaton_search.CHUNK = size
    try:
        found = automaton_search.occurrences(wanted, marked)
    finally:
        automaton_search.CHUNK = before
    bag = Counter(terms(text))
    assert {wanted[i]: n for i, n in found.items()} == {t: bag[t] for t in wanted if bag[t]}
    assert automaton_search.term_count(marked) == sum(bag.values())


def cheapest(codes: list[int]) -> tuple[int, str]:
    """Least cost and first letters by plain dynamic programming from the end."""
    after = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    turn = [2, 2, 3, 2]
    kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
    for code in reversed(codes):
        role, fault = code & 3, code >> 2
        late, now = int(fault == 3), []
        for q in range(4):
            ways = [(3 + after[q][0], "D" + after[q][1])]
            if fault not in (1, 2):
                ways.append((2 + late + after[turn[q]][0], "R" + after[turn[q]][1]))
                if (q, role) in kept:
                    ways.append((late + after[kept[q, role]][0], "K" + after[kept[q, role]][1]))
            now.append(min(ways))
        for q in (3, 2, 0, 1, 2, 3, 0, 1):
            now[q] = min(now[q], (2 + now[turn[q]][0], "I" + now[turn[q]][1]))
        after = now
    return after[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=30), st.integers(1, 8))
def test_segments_give_the_cheapest_first_repair(codes, size):
    cut = [codes[a : a + size] for a in range(0, len(codes), size)]
    exits, priced = list(conversation_repair.END_PRICES), []
    for own in reversed(cut):
        priced.append(exits)
        borders = conversation_repair.border_prices(own)
        exits = [min(borders[4 * q + x] + exits[x] for x in range(4)) for q in range(4)]
    state, cost, audit = 0, 0, ""
    for own, prices in zip(cut, reversed(priced)):
        state, more, letters, plan = conversation_repair.traces(own, prices)[state]
        cost, audit = cost + more, audit + letters
        assert len(plan) == len(own)
    more = conversation_repair.END_ROWS[state]
    assert (cost + 2 * len(more), audit + "I" * len(more)) == cheapest(codes)
    assert exits[0] == cheapest(codes)[0]


SPACE = " \t\n\x0b\x0c\r"


def repaired(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, sha of rows (turn, role, text) in order."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    kinds = ["sua".find(r[1][:1]) % 4 if r[1] else 3 for r in rows]
    cost, audit = cheapest([k + 4 * f for k, f in zip(kinds, faults)])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a, b) not in {(0, 1), (1, 2), (2, 1)} for a, b in zip(kinds, kinds[1:]))
    out, state, left = [], "", list(rows)
    for letter in audit:
        following = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((following, ""))
        else:
            _, role, text = left.pop(0)
            if letter == "D":
                continue
            out.append((role if letter == "K" else following, text))
        state = out[-1][0][0]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) and not left
    return (gaps, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def brute_conversations(rows: list[tuple]) -> dict:
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        found[conv] += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: repaired(sorted(own, key=order)) for conv, own in found.items()}


def conversations() -> list[tuple]:
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "a", "Übung"]
    texts = ["Hello.", "Well!", "cut off", " \t", "", None, "Why?\n ", "Hello.", "end. ", "日本。"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 12)):
            pick = rng.randrange(100)
            role = ("user", "assistant")[turn % 2] if pick < 70 else roles[pick % len(roles)]
            text = f"Text {conv} {turn}." if rng.randrange(3) else rng.choice(texts)
            rows.append((conv, None if pick == 99 else turn + (pick > 95), role, text))
    rows += [(500, t, "user" if t % 3 else "assistant", f"t{t % 50}{'.' if t % 5 else ''}") for t in range(400)]
    rows += [rows[3], rows[7], (501, 0, "user", "x." * 50_000), (502, None, None, None), (503, None, "user", "a."), (503, None, "user", "a.")]
    rows += [(600 + i, 0, "user", "Hi.") for i in range(40)]  # some have no row after damage
    return rows


def test_repair(llm, tmp_path):
    rows = conversations()
    frame = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS step", "3 AS segment", "4 AS cost")
    frame.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_conversation_repair(llm, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_conversations(rows) and len(got) == len({r[0] for r in rows})


def test_repaired_rows(llm):
    rows = [(1, 0, "assistant", "A."), (1, 1, "user", "B."), (1, 2, "user", "B."), (2, 0, "system", "S.")]
    frame = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out, report = conversation_repair.repair(frame)
    got = [(r["key"], r["role"], r["text"], r["edit"]) for r in out.orderBy("row_index", "step").collect()]
    assert got == [("=1", "user", "", "insert"), ("=1", "assistant", "A.", "keep"), ("=1", "user", "B.", "keep"), ("=1", "assistant", "", "insert")]
    assert {r["conv_id"]: r["cost"] for r in report.collect()} == {1: 7, 2: 3}
    none, report = conversation_repair.repair(frame.where("false"))
    assert none.count() == 0 and report.count() == 0


def test_fingerprints(llm, hard, nothing):
    got = piecewise_hash.fingerprints(hard).collect()
    rows = [(r[0], r[1] or "") for r in hard_rows()]
    assert len(got) == len(rows) and piecewise_hash.fingerprints(nothing).count() == 0
    prints = {t: piecewise_hash.fingerprint(t.encode()) for _, t in rows}
    assert Counter((r["doc_id"], r["n_chars"], r["fingerprint"]) for r in got) == Counter((d, len(t), prints[t]) for d, t in rows)
    by_id = defaultdict(list)
    for d, t in rows:
        by_id[d].append(t)
    order = sorted((d for d in by_id if d is not None), reverse=True)
    single = [d for d in order if len(by_id[d]) == 1]
    seen = {r["doc_id"]: r for r in got}
    for d in single:
        at = order.index(d)
        following = order[at + 1] if at + 1 < len(order) else None
        if len(by_id[following]) > 1:
            continue
        text, other = by_id[d][0], by_id[following][0]
        n = len(text) // 3
        edited = (text[: len(text) - n] + other[:n]).encode()
        row = seen[d]
        assert row["edited_sha256"] == hashlib.sha256(edited).hexdigest()
        assert row["edited_fingerprint"] == piecewise_hash.fingerprint(edited)
        assert row["near_edited"] == piecewise_hash.likeness([(prints[text], row["edited_fingerprint"])])[0]
        assert row["near_next"] == piecewise_hash.likeness([(prints[text], prints[other])])[0]
    alone = piecewise_hash.fingerprints(hard.where("doc_id = 9").limit(1)).collect()
    assert [r["near_next"] for r in alone] == [1.0]


def slow_fingerprint(data: bytes) -> str:
    """Every end and letter by the letter."""
    levels = []
    for i in range(len(data)):
        h = sum(data[i - k] * pow(piecewise_hash.MULTIPLIER, k) for k in range(min(7, i + 1))) % 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 13
        levels.append(len(bin(h)) - len(bin(h).rstrip("1")))
    level = max([k for k in range(33) if sum(x >= k for x in levels) >= 32], default=0)
    rows = []
    for k in (level, level + 1):
        pieces, piece = [], b""
        for i, x in enumerate(levels):
            piece += data[i : i + 1]
            if x >= k and len(pieces) < 63:
                pieces.append(piece)
                piece = b""
        pieces += [piece] * bool(piece)
        rows.append("".join(piecewise_hash.LETTERS[(zlib.crc32(p) * 0x9E3779B1 % 2**32) >> 26] for p in pieces))
    return f"{1 << level}:{rows[0]}:{rows[1]}"


def slow_likeness(a: str, b: str) -> float:
    """Edit distance without replacement, letter by letter."""
    table = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, table[0] = table[0], i + 1
        for j, y in enumerate(b):
            before, table[j + 1] = table[j + 1], before if x == y else 1 + min(table[j], table[j + 1])
    need = min(7, len(a), len(b))
    shared = any(a[i : i + need] in b for i in range(len(a) - need + 1))
    return 1 - table[-1] / (len(a) + len(b)) if shared else 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 100))
def test_fingerprint_ends(data, part):
    piecewise_hash.PART, before = part, piecewise_hash.PART
    try:
        assert piecewise_hash.fingerprint(data) == slow_fingerprint(data)
    finally:
        piecewise_hash.PART = before


@settings(max_examples=150, deadline=None)
@given(st.text("AB+", min_size=1, max_size=64), st.text("AB+", min_size=1, max_size=64))
def test_likeness_is_the_edit_distance(a, b):
    assert piecewise_hash.row_likeness([(a, b)])[0] == pytest.approx(slow_likeness(a, b))


def test_likeness_tells_edits_from_other_texts():
    rng = random.Random(1)
    texts = [sentence(rng, n) for n in (30, 200, 3000, 20_000)]
    prints = [piecewise_hash.fingerprint(t.encode()) for t in texts]
    for text, own in zip(texts, prints):
        changed = text[: len(text) // 2] + " a few more words " + text[len(text) // 2 :]
        assert piecewise_hash.likeness([(own, piecewise_hash.fingerprint(changed.encode()))])[0] > 0.75
    others = [piecewise_hash.fingerprint(sentence(rng, 3000).encode()) for _ in range(20)]
    assert max(piecewise_hash.likeness([(prints[2], x) for x in others])) < 0.3
    assert piecewise_hash.likeness([("1::", "1::"), ("1::", prints[0]), (prints[0], prints[3])]) == [1, 0, 0]
    assert len(piecewise_hash.fingerprint(b"a" * 100_000)) < 150
