from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest

from phaseflow.llm import nearcopies
from phaseflow.llm.simhash import spanning
from tests.llm.conftest import sentence


def plain(text: str | None) -> set:
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(texts: list) -> list[int]:
    sets = [plain(t) for t in texts]
    pairs = [(x, y) for x in range(len(sets)) for y in range(x) if 10 * len(sets[x] & sets[y]) >= 8 * len(sets[x] | sets[y])]
    return spanning(len(texts), iter([tuple(np.array(c) for c in zip(*pairs, strict=True))])).tolist()


@pytest.fixture(scope="module")
def band():
    """Copies with words changed until they are between about 0.7 and 0.95 alike."""
    rng, out = random.Random(5), ["", None, "a b", "A  b", "a c"]
    for _ in range(40):
        words = sentence(rng, 150).split()
        out.append(" ".join(words))
        for changes in (1, 2, 3, 4):
            changed = list(words)
            for at in rng.sample(range(5, 145), changes):
                changed[at] = "changed"
            out.append(" ".join(changed))
    return out


def test_every_pair_of_the_band(spark, band):
    want = brute(band)
    df = spark.createDataFrame(list(enumerate(band)), "doc_id long, text string").repartition(5)
    assert {r.id: r.lead_id for r in nearcopies.near_copies(df).collect()} == dict(enumerate(want))
    kept = corpus_pipeline.simhash_stage(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_shards(spark, band, monkeypatch):
    monkeypatch.setattr(nearcopies.links, "__defaults__", (2,))
    monkeypatch.setattr(nearcopies, "CELL_CHARS", 1 << 12)
    df = spark.createDataFrame(list(enumerate(band)), "doc_id long, text string")
    assert {r.id: r.lead_id for r in nearcopies.near_copies(df).collect()} == dict(enumerate(brute(band)))


def test_odd_rows(docs, texts, no_docs):
    ids = sorted({r[0] for r in texts})
    by_id = {r[0]: r[1] for r in texts}
    want = brute([by_id[i] for i in ids])
    assert {r.id: r.lead_id for r in nearcopies.near_copies(docs).collect()} == {i: ids[k] for i, k in zip(ids, want, strict=True)}
    assert nearcopies.near_copies(no_docs).count() == 0


def test_only_the_row_that_is_a_near_copy_goes(spark):
    rng = random.Random(9)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    rows = [(1, a), (None, a + " more"), (None, b), (None, b), (7, c), (3, c + " more"), (7, d), (9, None), (9, "")]
    kept = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = [(r.doc_id, r.text) for r in kept]
    assert {x for x in got if x[1]} == {(1, a), (None, b), (3, c + " more"), (7, d)}
    assert [x[0] for x in got if not x[1]] == [9] and len(got) == 5
