"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language. What speaks for a language are the word's
affixes, its character n-grams and its entry in a lexicon; learned transitions
tie neighbouring words together, so a text may switch languages. Words are
judged by their forward-backward marginals, and a document by their sum.

The model is fitted on a bounded sample of labelled documents, from texts
stitched out of runs of different languages, so that transitions are learned.
Prediction sees nothing but the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tallyhouse.llm.tokens import texts_of

#: The sample: about so many documents of each language, chosen by hash, of at most so many characters.
DOCS_PER_LANGUAGE, SAMPLE_CHARS = 200, 20_000
#: Hash buckets of the n-gram and affix weights; words seen so often in the sample enter the lexicon.
BUCKETS, LEXICON_COUNT = 1 << 16, 3
#: Training: steps, texts of a step, words of a text, longest run of one language.
STEPS, TEXTS, WORDS, RUN = 400, 64, 40, 25
#: Words whose scores a worker keeps; words handled at once; words of a segment.
STORE, LOT, SEGMENT = 400_000, 200_000, 64
#: Code points of a word at most; longer runs of letters are several words of the chain.
WIDTH = 24
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters; those longer than ``WIDTH`` are cut into parts of about equal length."""
    found = WORD.findall(text.lower())
    if found and max(map(len, found)) > WIDTH:
        found = [part for w in found for part in ((w,) if len(w) <= WIDTH else _parts(w))]
    # Superscript digits and their like are no letters.
    return [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def _parts(word: str) -> list[str]:
    count = -(-len(word) // WIDTH)
    edges = [i * len(word) // count for i in range(count + 1)]
    return [word[a:b] for a, b in zip(edges, edges[1:])]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points with a mark before and after each word, and the lengths with marks."""
    plain = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    lengths = (plain > 0).sum(axis=1)
    codes = np.zeros((len(words), WIDTH + 2), dtype=np.uint64)
    codes[:, 0] = 1
    codes[:, 1:-1] = plain
    codes[np.arange(len(words)), lengths + 1] = 2
    return codes, lengths + 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def features(words: list[str], lexicon: np.ndarray) -> np.ndarray:
    """Rows of weight numbers: n-grams, prefixes and suffixes by hash, then the lexicon entry; -1 where there is none."""
    codes, lengths = _codes(words)
    n, width = codes.shape
    base = np.uint64(0x100000001B3)
    columns = []
    at = np.arange(width)
    for size in (2, 3):
        rolled = codes[:, : width - size + 1].copy()
        for k in range(1, size):
            rolled = rolled * base + codes[:, k : width - size + 1 + k]
        hashed = (_mixed(rolled + np.uint64(size)) % np.uint64(BUCKETS)).astype(np.int64)
        columns.append(np.where(at[: width - size + 1] + size <= lengths[:, None], hashed, -1))
    rows = np.arange(n)
    for size in (3, 4):
        for side in (0, 1):  # prefix, suffix
            total = np.full(n, 7 + side * 4 + size, dtype=np.uint64)
            for k in range(size):
                place = np.full(n, k) if side == 0 else np.maximum(lengths - 1 - k, 0)
                total = total * base + codes[rows, place]
            hashed = (_mixed(total) % np.uint64(BUCKETS)).astype(np.int64)
            columns.append(np.where(lengths > size, hashed, -1)[:, None])
    own = word_keys(codes)
    entry = np.searchsorted(lexicon, own)
    known = (entry < len(lexicon)) & (lexicon[np.minimum(entry, max(len(lexicon) - 1, 0))] == own) if len(lexicon) else np.zeros(n, dtype=bool)
    columns.append(np.where(known, BUCKETS + entry, -1)[:, None])
    return np.concatenate(columns, axis=1)


def word_keys(codes: np.ndarray) -> np.ndarray:
    total = np.zeros(len(codes), dtype=np.uint64)
    for k in range(codes.shape[1]):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[:, k]
    return _mixed(total)


@dataclass
class Model:
    languages: list[str]
    lexicon: np.ndarray  # sorted word keys
    weights: np.ndarray  # buckets and lexicon, one row more of zeros for "none"
    transitions: np.ndarray  # logarithms, from row to column
    store: dict[str, int] = field(default_factory=dict)
    known: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "store": {}, "known": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """exp(score) of each language for each word, largest 1."""
        found = features(words, self.lexicon)
        total = np.zeros((len(words), len(self.languages)), dtype=np.float32)
        for column in found.T:
            total += self.weights[column]
        return np.exp(total - total.max(axis=1, keepdims=True))

    def numbers(self, words: list[str]) -> np.ndarray:
        """The rows of ``known`` that hold the words' scores."""
        new = set(words).difference(self.store)
        if new:
            if len(self.store) > STORE:
                self.store, self.known = {}, None
                new = set(words)
            ordered = sorted(new)
            parts = [self.scores(ordered[i : i + 20_000]) for i in range(0, len(ordered), 20_000)]
            self.store.update(zip(ordered, range(len(self.store), len(self.store) + len(ordered))))
            self.known = np.concatenate([*([self.known] if self.known is not None else []), *parts])
        return np.fromiter(map(self.store.__getitem__, words), dtype=np.int64, count=len(words))


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Forward-backward marginals of the words of many texts (their lengths, all above 0) at once.

    Texts are cut into segments that all move in step. A segment's product of
    matrices says how it carries a belief from its start to its end; combining
    the products gives every segment its true beliefs at both ends.
    """
    n, k = scores.shape
    step = np.exp(transitions - transitions.max())
    count = -(-lengths // SEGMENT)
    first = np.cumsum(count) - count  # the first segment of each text
    segments = int(count.sum())
    text = np.repeat(np.arange(len(lengths)), count)
    order = np.arange(segments) - first[text]
    begin = (np.cumsum(lengths) - lengths)[text] + order * SEGMENT
    size = np.minimum(lengths[text] - order * SEGMENT, SEGMENT)
    place = np.minimum(begin[:, None] + np.arange(SEGMENT), n - 1)
    psi = scores[place].astype(np.float64)
    psi[np.arange(SEGMENT) >= size[:, None]] = 0

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.reshape(len(x), -1).max(axis=1).reshape((-1,) + (1,) * (x.ndim - 1))

    carry = np.broadcast_to(np.eye(k), (segments, k, k)).copy()
    for s in range(SEGMENT):
        on = size > s
        if on.all():
            carry = scaled((carry @ step) * psi[:, s, None, :])
        elif on.any():
            carry[on] = scaled((carry[on] @ step) * psi[on, s, None, :])
        else:
            break
    before, after = np.ones((segments, k)), np.ones((segments, k))
    for s in range(1, int(count.max())):
        here = first[count > s] + s
        before[here] = scaled(np.einsum("gi,gij->gj", before[here - 1], carry[here - 1]))
        back = (first + count - 1 - s)[count > s]
        after[back] = scaled(np.einsum("gij,gj->gi", carry[back + 1], after[back + 1]))
    forward = np.zeros_like(psi)
    belief = before
    for s in range(SEGMENT):
        belief = (belief @ step) * psi[:, s]
        belief /= np.maximum(belief.max(axis=1, keepdims=True), 1e-300)
        forward[:, s] = belief
    belief = after.copy()
    for s in range(SEGMENT - 1, -1, -1):
        on = (size > s)[:, None]
        both = forward[:, s] * belief
        forward[:, s] = both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)
        new = (psi[:, s] * belief) @ step.T
        belief = np.where(on, new / np.maximum(new.max(axis=1, keepdims=True), 1e-300), belief)
    return forward[np.arange(SEGMENT) < size[:, None]]


def fit(sample: list[tuple[str, str]], steps: int = STEPS, seed: int = 11) -> Model:
    """Learn from (language, text) pairs by stochastic gradient on the conditional likelihood."""
    texts = [(lang, words_of(text)) for lang, text in sorted(sample)]
    texts = [(lang, words) for lang, words in texts if words]
    languages = sorted({lang for lang, _ in texts})
    k, rng = len(languages), np.random.default_rng(seed)
    counts = Counter(w for _, words in texts for w in words)
    vocabulary = {w: i for i, w in enumerate(sorted(counts))}
    frequent = [w for w, c in counts.items() if c >= LEXICON_COUNT]
    lexicon = np.unique(word_keys(_codes(frequent)[0])) if frequent else np.zeros(0, dtype=np.uint64)
    weights = np.zeros((BUCKETS + len(lexicon) + 1, k))
    transitions = np.zeros((k, k))
    if k < 2:
        return Model(languages, lexicon, weights.astype(np.float32), transitions)
    table = features(list(vocabulary), lexicon)
    table[table < 0] = len(weights) - 1
    by_language = [[np.array([vocabulary[w] for w in words]) for lang, words in texts if lang == own] for own in languages]
    seen_w, seen_t = np.full_like(weights, 1e-3), np.full_like(transitions, 1e-3)
    for _ in range(steps):
        ids, gold = np.zeros((TEXTS, WORDS), dtype=np.int64), np.zeros((TEXTS, WORDS), dtype=np.int64)
        for row in range(TEXTS):
            at = 0
            while at < WORDS:
                lang = int(rng.integers(k))
                words = by_language[lang][rng.integers(len(by_language[lang]))]
                start = rng.integers(len(words))
                run = words[start : start + int(rng.integers(1, RUN + 1))][: WORDS - at]
                ids[row, at : at + len(run)] = run
                gold[row, at : at + len(run)] = lang
                at += len(run)
        used = table[ids]
        score = weights[used].sum(axis=2)
        psi = np.exp(score - score.max(axis=2, keepdims=True))
        step = np.exp(transitions)
        forward, backward = np.zeros_like(psi), np.ones_like(psi)
        belief = np.ones((TEXTS, k))
        for t in range(WORDS):
            belief = (belief @ step) * psi[:, t]
            belief /= belief.sum(axis=1, keepdims=True)
            forward[:, t] = belief
        for t in range(WORDS - 2, -1, -1):
            belief = (psi[:, t + 1] * backward[:, t + 1]) @ step.T
            backward[:, t] = belief / belief.sum(axis=1, keepdims=True)
        marginal = forward * backward
        marginal /= marginal.sum(axis=2, keepdims=True)
        pairs = forward[:, :-1, :, None] * step * (psi[:, 1:] * backward[:, 1:])[:, :, None, :]
        pairs /= pairs.sum(axis=(2, 3), keepdims=True)
        error = (marginal - np.eye(k)[gold]) / TEXTS
        slope = np.zeros_like(weights)
        np.add.at(slope, used.reshape(-1, used.shape[2]), error.reshape(-1, 1, k))
        slope[-1] = 0
        slope += 1e-4 * weights
        pull = pairs.sum(axis=(0, 1)) / TEXTS
        np.subtract.at(pull, (gold[:, :-1], gold[:, 1:]), 1 / TEXTS)
        seen_w += slope**2
        seen_t += pull**2
        weights -= 0.3 * slope / np.sqrt(seen_w)
        transitions -= 0.1 * pull / np.sqrt(seen_t)
    return Model(languages, lexicon, weights.astype(np.float32), transitions)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(documents: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(language, text) of about ``per_language`` labelled documents of each language that are not held out."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).where(F.length("text") <= SAMPLE_CHARS)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 20)) / (1 << 20)
    return [tuple(r) for r in labelled.where(chance < share[F.col("lang")]).select("lang", "text").collect()]


PREDICTION = [("lang_pred", StringType()), ("score", DoubleType()), ("n_words", LongType()), ("n_switches", LongType()), ("certainty", DoubleType())]


def predict(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id unless given) and lang_pred, score, n_words, n_switches, certainty for each document.

    A kept column that has the name of a result is left out.

    ``lang_pred`` has the largest sum of word marginals and ``score`` is their
    mean (0 to 1); ties go to the first name. A text that is null or has no
    letters, and any text if nothing was learned, is ``und`` with score 0.
    ``n_switches`` counts neighbouring words labelled differently; ``certainty``
    is the mean of each word's largest marginal, whatever its language.
    """
    kept = [c for c in keep or ["doc_id"] if c not in dict(PREDICTION)]
    rows = documents.select(F.col("text").alias("_text"), *kept)
    schema = StructType([*rows.schema.fields[1:], *[StructField(n, t) for n, t in PREDICTION]])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.languages
        for batch in batches:
            out = [(UNKNOWN, 0.0, 0, 0, 0.0)] * batch.num_rows
            lot: list[tuple[int, list[str]]] = []
            held = 0

            def flush() -> None:
                lengths = np.array([len(w) for _, w in lot])
                numbers = model.numbers([w for _, words in lot for w in words])
                found = marginals(model.known[numbers], lengths, model.transitions)
                start = np.cumsum(lengths) - lengths
                sums = np.add.reduceat(found, start, axis=0)
                best = sums.argmax(axis=1)
                labels = found.argmax(axis=1)
                sure = np.add.reduceat(found.max(axis=1), start)
                turns = np.append(0, labels[1:] != labels[:-1])
                turns[start] = 0
                turns = np.add.reduceat(turns, start)
                for (row, _), b, s, n, t, c in zip(lot, best, sums, lengths, turns, sure):
                    out[row] = (names[b], min(1.0, float(s[b] / n)), int(n), int(t), min(1.0, float(c / n)))

            for row, text in enumerate(texts_of(batch.column(0))):
                words = words_of(text)
                if words and names:
                    lot.append((row, words))
                    held += len(words)
                elif words:
                    out[row] = (UNKNOWN, 0.0, len(words), 0, 0.0)
                if held >= LOT:
                    flush()
                    lot, held = [], 0
            if lot:
                flush()
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], schema.names)

    return rows.mapInArrow(label, schema)


def identify(documents: DataFrame, per_language: int = DOCS_PER_LANGUAGE, keep: list[str] | None = None) -> DataFrame:
    """Fit on the documents' own labels (those not held out) and predict all of them."""
    return predict(documents, fit(training_sample(documents, per_language)), keep)
