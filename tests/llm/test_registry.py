"""The registered queries that SQL cannot express, against plain Python over the same tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from phaseflow.llm import packing, registry, toxicity
from tests.llm.test_simhash import brute, plain
from tests.llm.test_tokens_and_packing import ids

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def tokens_of(documents):
    return {i: ids(t) for i, t in documents.items()}


def test_op3(spark, tokens_of):
    df = registry.op3_packing(spark, DATA)
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = df.collect()
    pieces, used = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(tokens_of)
    for i, x in tokens_of.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(x) // packing.CAPACITY)))
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert all(r.length == packing.CAPACITY for r in own[1:]) and sum(r.length for r in own) == len(x)
        assert all(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for r in own)
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    completion = packing.Completion(Counter(r.length for r in out))
    assert len(used) == completion.bound()  # as few as can be


def test_op5(spark, documents):
    fps = {i: plain(t) for i, t in documents.items()}
    want = brute(fps)
    out = registry.op5_simhash(spark, DATA)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(tuple(r) for r in out.collect()) == sorted((i, f"{fps[i]:016x}", want[i]) for i in fps)


def noisy_or(model: toxicity.Model, text: str | None) -> float:
    """Score of a text, sentence by sentence and feature by feature."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]+", text or ""):
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", sentence)}
        total = sum(model.weights.get(f, 0.0) for w in words for f in toxicity.features(w))
        if total:
            clean *= 1 - 1 / (1 + math.exp(-(model.bias + total)))
    return 1 - clean


def test_op7(spark, documents):
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in documents}
    marked = {i: y for i, y in duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{DATA}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY 1").fetchall() if i in held}
    learnt = sorted(i for i in marked if not held[i])
    model = toxicity.fit([documents[i] or "" for i in learnt], [marked[i] for i in learnt])
    out = registry.op7_toxicity(spark, DATA)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == set(documents)
    for i, r in rows.items():
        assert r.held_out == held[i] and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
        assert r.score == pytest.approx(noisy_or(model, documents[i]), abs=1e-6)
    judged = [(rows[i].predicted, y) for i, y in marked.items() if held[i]]
    assert len(judged) > 30 and np.mean([a == b for a, b in judged]) > 0.85  # of some hundred labels at this size


def test_op8(spark, documents, tokens_of):
    out = registry.op8_tokens(spark, DATA)
    want, start = [], 0
    for i in sorted(documents):
        want.append((i, start, len(tokens_of[i]), zlib.crc32(tokens_of[i].tobytes())))
        start += len(tokens_of[i])
    assert sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
