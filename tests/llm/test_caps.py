from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from phaseflow.llm import caps
from phaseflow.llm.simhash import spanning


def brute(rows):
    links = {}
    ok = {}
    for i, v, label in rows:
        a = np.array([np.nan if x is None else x for x in v], float) if v is not None else np.zeros(0)
        ok[i] = label is not None and len(a) and np.isfinite(a).all() and a.any()
    ids = sorted({i for i, _, _ in rows})
    pairs = []
    for x in range(len(rows)):
        for y in range(x + 1, len(rows)):
            (i, v, a), (j, w, b) = rows[x], rows[y]
            if ok[i] and ok[j] and a == b and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= caps.COSINE:
                    links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                    pairs.append((ids.index(i), ids.index(j)))
    label = spanning(len(ids), iter([tuple(np.array(c) for c in zip(*pairs, strict=True))])) if pairs else np.arange(len(ids))
    return {i: (links.get(i, 0), ids[label[ids.index(i)]]) for i in ids}


def test_cases(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(40):
        c = rng.standard_normal(32)
        for _ in range(1 + k % 5):
            rows.append((len(rows), (c + 0.12 * rng.standard_normal(32)).astype(np.float32).tolist(), int(k % 3)))
    copy = rows[3][1]
    rows += [(len(rows) + i, copy, rows[3][2]) for i in range(3)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 32, 1), (n + 2, [float("nan")] * 32, 1), (n + 3, [None] * 32, 1), (n + 4, copy, None), (n + 5, [], 1), (n + 6, [1.0], 1), (n + 7, [2.0], 1), (n + 8, [1e30, 1.0], 2), (n + 9, [2e30, 1.0], 2)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, key int").repartition(3)
    out = caps.near_duplicates(df)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == brute(rows)
    assert out.count() == len(rows)


def test_dense_cluster_in_cells(spark, monkeypatch):
    monkeypatch.setattr(caps, "SHARD", 16)
    rng = np.random.default_rng(2)
    c = rng.standard_normal(16)
    rows = [(i, (c + 0.1 * rng.standard_normal(16)).tolist(), 0) for i in range(120)]
    out = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == brute(rows)


def pairs_at_the_threshold(dims, n=800):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((n, dims))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, caps.COSINE * x + np.sqrt(1 - caps.COSINE**2) * z


@pytest.mark.parametrize("dims", [32, 64])
@pytest.mark.parametrize("words", [8, 50, 300])
def test_recall_at_the_threshold(dims, words):
    x, y = pairs_at_the_threshold(dims)
    code = caps.Code.of(dims, words)
    sets = []
    for v in (x, y):
        r, f = code.decode(v)
        own = [set() for _ in v]
        for a, b in zip(r, f, strict=True):
            own[a].add(b)
        sets.append(own)
        (h1, b1), (h2, b2) = code.books[0]
        turned = v[:5] @ code.turns[0]
        for k in range(5):  # list decoding finds what all directions together give
            every = np.add.outer(turned[k, h1] @ b1.T, turned[k, h2] @ b2.T).ravel() >= code.threshold
            assert set(np.flatnonzero(every)) == {b for b in own[k] if b < code.per_code}
    assert np.mean([len(o) for o in sets[0]]) == pytest.approx(caps.CODES * caps.EXPECTED, rel=0.3)
    assert np.mean([bool(a & b) for a, b in zip(*sets, strict=True)]) > 0.99
    s, t = (np.stack([w.view(np.uint64) for w in code.signature(v)], 1) for v in (x, y))
    assert np.mean(np.bitwise_count(s ^ t).sum(1) <= caps.SIGNS) > 0.999


def test_a_million_vectors_need_little_memory():
    tracemalloc.start()
    try:
        code = caps.Code(64, int(np.ceil(np.sqrt(1_000_000 / 2))))
        code.decode(pairs_at_the_threshold(64, 256)[0])
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()


def test_ids_and_columns(spark):
    """Rows with a null id link with nothing, those with one id share their links; other columns stay out, whatever their names."""
    rows = [(None, [1.0, 0.0], 0), (4, [1.0, 0.01], 0), (4, [0.0, 1.0], 0), (6, [0.01, 1.0], 0), (6, None, 0), (8, [1.0, 1.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<double>, label int, id int, v string, filter double")
    out = caps.near_duplicates(df)
    assert out.columns == ["vec_id", "n_links", "component_id"]
    assert sorted((r.vec_id or 0, r.n_links) for r in out.collect()) == [(0, 0), (4, 1), (4, 1), (6, 0), (6, 1), (8, 0)]


def test_nothing_usable(spark):
    rows = [(1, None, 0), (2, [0.0], 0), (3, [1.0], None), (4, [float("inf")], 0)]
    out = caps.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted(tuple(r) for r in out.collect()) == [(i, 0, i) for i in range(1, 5)]


def test_empty(spark):
    assert caps.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
