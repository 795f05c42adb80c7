from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, score int, id int, hashes string"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ed", "in", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Rows with every odd case: nulls, empty, blanks, copies, near copies, shared passages, ties, a long text."""
    rng = random.Random(3)
    shared = sentence(rng, 40)
    base = [sentence(rng, rng.randint(3, 120)) + "." for _ in range(60)]
    out = [None, "", " \n\t ", "a", "one two", "word " * 30, "é ü ñ " * 20, shared, shared]
    out += base + base[:12]
    out += [b.replace("th", "ht", 1) for b in base[:12]]
    out += [f"{sentence(rng, 20)} {shared} {sentence(rng, 20)}" for _ in range(10)]
    out += ["x" * 300, "x" * 120, "ab" * 100, "A B C D E\n" * 6, "line one here\nline two here\nline one here", sentence(rng, 4000)]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or ""), 1, 2, 3, "z") for i, t in enumerate(out)]
    return [*rows, rows[20], rows[20]]  # repeated rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(texts, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
