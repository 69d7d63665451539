"""Hashes of the words and word shingles of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

#: A-Z become a-z; digits, letters and every byte of a non-ASCII character belong to words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.zeros(256, dtype=bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(which: str, n: int) -> np.ndarray:
    """BASE (up) or its inverse (down) to the powers 0 to n - 1, modulo 2^64."""
    if len(_POWERS[which]) < n:
        factors = np.full(max(n, 1 << 20), BASE if which == "up" else INVERSE, dtype=np.uint64)
        factors[0] = 1
        _POWERS[which] = np.multiply.accumulate(factors)
    return _POWERS[which][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values (nulls are empty)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    return text, offsets - offsets[0]


def word_hashes(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One hash for each word in order, and the offsets of each text's words among them."""
    if not len(text):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    low = LOWER[text]
    inside = np.zeros(len(low) + 1, dtype=bool)
    inside[:-1] = IN_WORD[low]
    border = np.zeros(len(low) + 1, dtype=bool)
    border[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:]
    ends = np.zeros(len(low) + 1, dtype=bool)
    ends[1:] = inside[:-1] & (~inside[1:] | border[1:])
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers("up", len(low)), out=sums[1:])
    hashes = mixed((sums[last] - sums[first]) * powers("down", len(low))[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, offsets)


def lots(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut texts into neighbouring lots (first, end) of about ``limit`` bytes, so that arrays over their bytes stay small."""
    first = 0
    while first < len(offsets) - 1:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end
        first = end


def shingle_sets(text: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of ``size`` words in a row; fewer words are one shingle, none no shingle."""
    return [own for a, b in lots(offsets) for own in _sets(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)]


def _sets(text: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    words, at = word_hashes(text, offsets)
    multipliers = mixed(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    rows = np.zeros(max(len(words) - size + 1, 0), dtype=np.uint64)
    for k, m in enumerate(multipliers):
        rows += words[k : k + len(rows)] * m
    rows = mixed(rows)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rows[a : b - size + 1]))
        elif b > a:
            short = np.append(words[a:b] * multipliers[: b - a], np.uint64(b - a)).sum(keepdims=True)
            out.append(mixed(short))
        else:
            out.append(rows[:0])
    return out
