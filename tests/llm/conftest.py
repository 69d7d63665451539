from __future__ import annotations

import random

import pytest

from tallyhouse.llm.queries import prepared

WORDS = "alpha beta gamma delta river stone cloud paper green seven light mouse table chair quiet storm über naïve".split()


@pytest.fixture(scope="session")
def llm(spark):
    return prepared(spark)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars and columns whose names clash with the operators' own: copies, near copies, ties, nulls, one long text."""
    rng = random.Random(3)
    base = [sentence(rng, 60) for _ in range(12)]
    texts = [*base, *base[:4], *[t.replace("river", "lake", 1) + " end" for t in base[:5]], base[0] + "\n" + base[1], None, "", " ", "12 34 !!", "Été à l'eau\r\n\r\nFIN  fin", "one two three", "x" * 500]
    texts += ["\n".join(["Same Line ", f"own {i}", " same line"]) for i in range(12)]
    texts.append("\n".join(sentence(rng, 12) for _ in range(800)))
    rows = [(i * 3 % 101, t, "en" if i % 3 else None, "s" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], (None, base[2], "en", None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(llm):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    frame = llm.createDataFrame(hard_rows(), columns).repartition(3)
    clash = {c: "1" for c in ("n", "h", "size", "pos", "score", "length", "start", "marks", "keys", "anchor", "shard")}
    return frame.selectExpr("*", *[f"{v} AS {k}" for k, v in clash.items()])


@pytest.fixture(scope="session")
def nothing(hard):
    return hard.where("false")
