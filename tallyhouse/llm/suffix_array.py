"""Suffix arrays by two-stage sorting."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number; zeros follow the end."""
    padded = np.concatenate((text, np.zeros(8, dtype=np.uint8))).astype(np.uint64)
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one that starts a byte later; the last counts as smaller."""
    step = np.sign(np.diff(text.astype(np.int16)))
    step = np.append(step, 1)
    # A run of equal bytes takes the type of the byte that ends it.
    here = np.where(step != 0, np.arange(len(step)), len(step))
    return step[np.minimum.accumulate(here[::-1])[::-1]] > 0


def _sorted(starts: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes by their first ``depth`` bytes, eight at a time, going on only where there are ties."""
    order = starts[np.argsort(words[starts], kind="stable")]
    value = words[order]
    tied = np.zeros(len(order), dtype=bool)
    group = np.cumsum(np.append(True, value[1:] != value[:-1])) if len(order) else np.zeros(0, dtype=np.int64)
    for at in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied[:] = False
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        deeper = order[where] + at
        value = np.where(deeper < len(words), words[np.minimum(deeper, len(words) - 1)], 0)
        by = np.lexsort((value, group[where]))
        order[where] = order[where][by]
        value = value[by]
        own = group[where]
        # Number the groups anew; what is not tied keeps a group of its own.
        split = np.zeros(len(order), dtype=np.int64)
        split[where[1:]] = (own[1:] == own[:-1]) & (value[1:] != value[:-1])
        group = group + np.cumsum(split)
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes of ``text`` in the order of their first ``depth`` bytes (ties in any order).

    ``text`` is bytes ending in 0. Only suffixes smaller than their successors
    are sorted; every other one is placed by a scan over the buckets of first
    bytes, in ascending order: it follows the order of its successor.
    """
    small = smaller_than_next(text)
    starts = np.flatnonzero(small)
    direct = _sorted(starts, words_at(text), depth)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        large, new = list(waiting[byte]), np.concatenate(waiting[byte]) if waiting[byte] else starts[:0]
        while len(new):  # runs of one byte lead to the same bucket
            before = new[new > 0] - 1
            new = before[(text[before] == byte) & ~small[before]]
            large.append(new)
        bucket = np.concatenate([*large, direct[bounds[byte] : bounds[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(text[before] > byte) & ~small[before]]
        bytes_before = text[before]
        by = np.argsort(bytes_before, kind="stable")
        before, bytes_before = before[by], bytes_before[by]
        for other in np.unique(bytes_before):
            a, b = np.searchsorted(bytes_before, [other, int(other) + 1])
            waiting[other].append(before[a:b])
        waiting[byte] = []
    return np.concatenate(out)


def common_prefix_reaches(starts: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """For each of ``starts`` but the first: whether it shares ``length`` bytes with the one before it."""
    same = np.ones(max(len(starts) - 1, 0), dtype=bool)
    for at in range(0, length, 8):
        where = np.flatnonzero(same)
        if not len(where):
            break
        a, b = words[starts[where] + at], words[starts[where + 1] + at]
        spare = np.uint64(8 * max(0, at + 8 - length))
        same[where] = (a >> spare) == (b >> spare)
    return same
