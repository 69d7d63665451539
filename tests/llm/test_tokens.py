"""Token files, separator scan and packing against direct encoding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyhouse.llm import packing, token_counts, token_files
from tallyhouse.llm.ordering import numbered
from tallyhouse.llm.queries import vocabulary
from tallyhouse.llm.tokens import PieceEncoder
from tallyhouse.session import scratch_dir
from tests.llm.conftest import hard_rows

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ENCODERS = {path: PieceEncoder(path) for path in (BYTES, WORDS)}


def direct(path: str, text: str | None) -> list[int]:
    return ENCODERS[path].library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sStTé½²Ωя日.,-<|\x1c\xa0́"), st.characters(codec="utf-8")), max_size=40), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    for path, encoder in ENCODERS.items():
        for text, ids in zip(texts, encoder.ids(texts), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == direct(path, text)


def test_token_files(llm, hard, nothing):
    path = scratch_dir(llm, "t")
    token_files.write_token_files(hard, path, BYTES, 0)
    got = token_files.read_token_files(llm, path).collect()
    rows = sorted(hard_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, start = [], 0
    for doc_id, text, *_ in rows:
        ids = direct(BYTES, text) + [0]
        raw = np.array(ids, dtype="<u4").tobytes()
        want.append((doc_id, start, len(ids), zlib.crc32(raw), bytearray(raw)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    some = hard_rows()[7]
    assert token_files.read_document(llm, path, some[0]) == [direct(BYTES, some[1]) + [0]]
    assert token_files.read_document(llm, path, 10**6) == []
    empty = scratch_dir(llm, "t")
    token_files.write_token_files(nothing, empty, BYTES, 0)
    assert token_files.read_token_files(llm, empty).count() == 0


def test_separator_scan(llm, hard, nothing):
    path = scratch_dir(llm, "t")
    token_counts.write_flat(hard, path, BYTES, 50256, block_ids=64)
    names = token_counts.flat_names(llm, path)
    got = token_counts.count_tokens(token_counts.flat_blocks(llm, path), 50256).join(names, ["shard", "ordinal"]).select("doc_id", "n_tokens").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], len(direct(BYTES, r[1]))) for r in hard_rows()), key=key)
    empty = scratch_dir(llm, "t")
    token_counts.write_flat(nothing, empty, BYTES, 50256)
    assert token_counts.count_tokens(token_counts.flat_blocks(llm, empty), 50256).count() == 0


@pytest.mark.parametrize("stream", [[5, 0, 0, 7, 7, 0, 9], [1, 2, 3], [0], [4, 4, 4, 4, 4, 4, 4, 0]])
def test_scan_of_one_stream_over_blocks_and_files(llm, stream):
    blocks = [(i // 4, i % 4 // 2, np.array(stream[i : i + 2], dtype="<u2").tobytes()) for i in range(0, len(stream), 2)]
    frame = llm.createDataFrame(blocks, "shard int, block long, ids binary")
    want, start = [], 0
    for part in [list(p) for p in _split(stream)]:
        ended = start + len(part) < len(stream)
        if ended or part:
            want.append((len(want), start, len(part), ended))
        start += len(part) + 1
    got = token_counts.count_tokens(frame, 0, across_shards=True).select("ordinal", "start", "n_tokens", "ended").collect()
    assert sorted(map(tuple, got)) == want


def _split(stream):
    part = []
    for x in stream:
        if x:
            part.append(x)
        else:
            yield part
            part = []
    yield part


def test_packing(llm, hard, nothing):
    capacity = 64
    got = packing.pack_documents(hard, WORDS, 1, capacity).collect()
    want = []
    for doc_id, text, *_ in hard_rows():
        ids = direct(WORDS, text) + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    _check_bins([(r.sequence_id, r.offset, r.length) for r in got], capacity)
    assert packing.pack_documents(nothing, WORDS).count() == 0


def _check_bins(rows, capacity):
    bins = defaultdict(list)
    for sequence, offset, length in rows:
        bins[sequence].append((offset, length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=31).astype(np.int64)
    patterns = packing.plan(counts)
    used = np.zeros_like(counts)
    for bins, pieces in patterns:
        assert bins > 0 and sum(length * times for length, times in pieces) <= 30
        for length, times in pieces:
            used[length] += bins * times
    assert (used == counts).all()
    assert sum(bins for bins, _ in patterns) <= max(1.5 * -(-sum(lengths) // 30) + 1, 0)


def test_two_fit_beats_greedy_filling():
    # Greedy: 6 + 3 leaves 1 of 10 unused; the 3 gives way to 2 + 2.
    counts = np.bincount([6, 3, 2, 2], minlength=11).astype(np.int64)
    assert packing.plan(counts)[0] == (1, [(6, 1), (2, 2)])


def test_lengths_out_of_bounds_raise(llm):
    rows = llm.createDataFrame([(1, 0, 5000)], "doc_id long, piece int, length long")
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(rows).collect()


def test_numbers_are_gapless(llm):
    rows = llm.range(1000).selectExpr("id % 7 AS k", "id").repartition(5)
    got = numbered(rows, ["k", "id"], running="k", total="before").orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(1000))
    assert [(r.k, r.id) for r in got] == sorted((i % 7, i) for i in range(1000))
    total = 0
    for r in got:
        assert r.before == total
        total += r.k


def test_name_of_the_separator_in_a_text(llm):
    texts = ["one <|endoftext|> two", "<|endoftext|>", "three four", "five"]
    path = scratch_dir(llm, "t")
    token_counts.write_flat(llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, BYTES, 50256)
    counted, names = token_counts.count_tokens(token_counts.flat_blocks(llm, path), 50256), token_counts.flat_names(llm, path)
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_counts.named_counts(counted, names).collect()}
    plain, start = PieceEncoder(BYTES, plain=True), 0
    for i, text in enumerate(texts):
        ids = plain.library.encode(text, add_special_tokens=False).ids
        assert 50256 not in ids and plain.library.decode(ids) == text
        assert got[i] == (start, len(ids))
        start += len(ids) + 1
    assert len(got) == len(texts)
    for left, right in ((counted, names.where("ordinal < 3")), (counted.where("ordinal < 3"), names)):
        with pytest.raises(Exception, match="documents and names of a shard differ"):
            token_counts.named_counts(left, right).collect()
