"""Token ids of whole texts with public tokenizers, one word at a time.

Both vocabularies split a text into pieces (words, numbers, punctuation, white
space) before any merge, and a piece's ids do not depend on its neighbours.
``PieceEncoder`` therefore asks the tokenizers library once per distinct piece
and keeps the answer for the life of the Python worker. Texts for which the
split below would not be certain go to the library whole. The ids are those of
``Tokenizer.encode(text, add_special_tokens=False)``; the tests compare them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# The split rule of byte-level BPE, with the letter and number
# classes written out for the first 256 code points.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
SUFFIX = "'(?:s|t|re|ve|m|ll|d)"
WITH_SPACE = re.compile(rf"{SUFFIX}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WITHOUT_SPACE = re.compile(rf"{SUFFIX}|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
ANY_SCRIPT = re.compile(r" ?\S+|\s+(?!\S)|\s")
# Python and the tokenizers disagree on whether the first four are white space;
# the last begins the name of a special id.
UNSURE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")

#: Pieces kept per worker; when full the store starts anew, which costs time only.
STORE = 1_000_000
#: Pieces joined into one text for a call of the library.
JOINED = 2_000
#: Characters of the texts that are split before the library is asked.
TOGETHER = 500_000


class PieceEncoder:
    """``ids(texts)`` yields the little-endian unsigned 32-bit ids of each text as bytes.

    With ``plain`` the name of a special id in a text is encoded like any other
    text, so no special id comes out.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        ends = [i for piece, i in self.library.get_vocab().items() if piece.endswith("</w>")]
        self.drops_space = bool(ends)
        self.ends = np.zeros(self.library.get_vocab_size(), dtype=bool)
        self.ends[ends] = True
        self.break_id = None if self.drops_space else self.library.encode("\n", add_special_tokens=False).ids[0]
        self.store: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None if it has to be encoded whole."""
        if any(mark in text for mark in UNSURE):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split() if self.drops_space else ANY_SCRIPT.findall(text)
        return WITHOUT_SPACE.findall(text.lower()) if self.drops_space else WITH_SPACE.findall(text)

    def learn(self, new: Iterable[str]) -> None:
        lone, joinable = [], []
        for piece in new:
            (joinable if piece.strip() and "\n" not in piece else lone).append(piece)
        for piece in lone:
            self.store[piece] = self.whole(piece)
        groups = [joinable[i : i + JOINED] for i in range(0, len(joinable), JOINED)]
        glue = " " if self.drops_space else "\n"
        for group, found in zip(groups, self.library.encode_batch_fast([glue.join(g) for g in groups], add_special_tokens=False)):
            ids = np.asarray(found.ids, dtype="<u4")
            if self.drops_space:
                stop = np.flatnonzero(self.ends[ids]) + 1
                start = np.concatenate(([0], stop[:-1]))
            else:
                breaks = np.flatnonzero(ids == self.break_id)
                stop, start = np.append(breaks, len(ids)), np.concatenate(([0], breaks + 1))
            raw = ids.tobytes()
            if len(stop) == len(group):
                self.store.update((p, raw[a * 4 : b * 4]) for p, a, b in zip(group, start.tolist(), stop.tolist()))
            else:  # a piece of another script fell into several words
                self.store.update((p, self.whole(p)) for p in group)

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.pieces(text) for text in texts]
        if len(self.store) > STORE:
            self.store.clear()
        new = set().union(*(p for p in split if p)).difference(self.store)
        if new:
            self.learn(new)
        for text, pieces in zip(texts, split):
            yield self.whole(text) if pieces is None else b"".join(map(self.store.__getitem__, pieces))


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The encoder of this worker for a vocabulary file."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = PieceEncoder(path, plain)
    return _ENCODERS[path, plain]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one by one; null becomes the empty text."""
    for value in column:
        yield value.as_py() or ""
