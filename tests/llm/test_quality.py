from __future__ import annotations

import re
from collections import Counter

import numpy as np

from phaseflow.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None) -> tuple:
    text = text or ""
    w = W.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if W.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_statistics(docs, texts):
    out = quality.judged(docs).collect()
    want = {r[0]: plain(r[1]) for r in texts}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out} == want
    assert len(out) == len(texts)
    assert not any(r.kept and r.base_failed for r in out)


def low(v, q):
    bins = np.sort(np.floor(v * 64))
    return bins[int(np.ceil(q * len(bins))) - 1]


def floored(c):
    c = c.copy()
    c[np.diag_indices(len(c))] = np.maximum(np.diag(c), np.square(quality.FLOORS))
    return c


def distances(x, mean, cov):
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def step(x, mean, cov):
    b = np.floor(np.log2(distances(x, mean, cov) + 1e-6) * 8)
    near = x[b <= np.sort(b)[int(np.ceil(quality.SUBSET * len(b))) - 1]]
    return near.mean(0), floored(np.cov(near.T, bias=True) * quality.CONSISTENT)


def estimates(x: np.ndarray) -> list[list[tuple]]:
    """(log determinant, mean, covariance) on the way from each start, in numpy."""
    median = np.array([(low(c, 0.5) + 0.5) / 64 for c in x.T])
    spread = np.array([(low(c, 0.75) + 1) / 64 - low(c, 0.25) / 64 for c in x.T]) / 1.349
    first = floored(np.diag(spread**2))
    z = (x - median) / np.sqrt(np.diag(first))
    u = z / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]
    signs = u.T @ u / len(u) * len(u.T) * np.sqrt(np.outer(np.diag(first), np.diag(first)))
    out = []
    for mean, cov in (step(x, median, first), (x.mean(0), floored(np.cov(x.T, bias=True))), (median, floored(signs))):
        way = [(np.linalg.slogdet(cov)[1], mean, cov)]
        for _ in range(quality.STEPS - 1):
            mean, cov = step(x, mean, cov)
            way.append((np.linalg.slogdet(cov)[1], mean, cov))
        out.append(way)
    return out


def mcd(x: np.ndarray) -> np.ndarray:
    """Squared distances under the estimate of the least determinant."""
    _, mean, cov = min((e for way in estimates(x) for e in way), key=lambda e: e[0])
    return distances(x, mean, cov)


def test_distances_and_outliers(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        words = ["w" * int(k) for k in rng.integers(3, 7, int(rng.integers(40, 400)))]
        words = [f"{w}{j}" for j, w in enumerate(words)]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "a" if i % 3 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.judged(df).collect()}
    for source in ("a", None):
        ids = [r[0] for r in rows if r[3] == source]
        stats = quality.vectors(quality.statistics(df)).filter(quality.F.col("doc_id").isin(ids)).sort("doc_id").select(*quality.X).collect()
        assert np.allclose([out[i].d2 for i in ids], mcd(np.array([list(r) for r in stats])), rtol=1e-6)
    assert [i for i, r in out.items() if not r.kept] == [i for i in out if i % 20 == 0]


def two_clusters() -> np.ndarray:
    """Rows of which a quarter depends on each other the other way round."""
    rng, floors, n = np.random.default_rng(0), np.array(quality.FLOORS), 200
    rng.normal(size=(n, 5))
    z = rng.normal(size=n) * 3
    x = np.stack([z * floors[0] * 3, z * floors[1] * 3 + rng.normal(size=n) * floors[1] * 0.5, *(rng.normal(size=n) * floors[k] * 2 for k in (2, 3, 4))], 1)
    k = int(n * 0.24)
    x[:k, 1] *= -1
    x[:k, 0] += rng.uniform(0, 6) * floors[0]
    return x


def test_the_start_of_the_least_determinant_counts(spark):
    x = two_clusters()
    least = [min(e[0] for e in way) for way in estimates(x)]
    assert min(least) < least[0] - 0.1  # medians and quartiles alone end in a worse minimum
    points = spark.createDataFrame([("g", *r) for r in x.tolist()], ", ".join([f"{quality.G} string", *(f"{c} double" for c in quality.X)]))
    best = quality.least_determinant(points).collect()
    assert len(best) == 1 and np.isclose(best[0].logdet, min(least))


ODD = {
    "few words": lambda w: w[:11],
    "long words": lambda w: [x * 3 for x in w],
    "symbols": lambda w: [x + "#" for x in w],
    "repeated lines": lambda w: [x for k in range(0, len(w), 2) for x in (f"{w[k]}\n", f"{w[k]}\n")],
    "repeated words": lambda w: [*w[: len(w) * 10 // 11], *w[: len(w) // 11]],
}


def test_each_statistic_alone_rejects(spark):
    rng = np.random.default_rng(1)
    some = lambda i, n: [f"{i}x{j}y"[: int(rng.integers(4, 9))] + str(j) for j in range(n)]
    rows = [(i, " ".join(some(i, int(rng.integers(380, 640))))) for i in range(120)]
    rows += [(1000 + k, " ".join(odd(some(1000 + k, 500)))) for k, odd in enumerate(ODD.values())]
    df = spark.createDataFrame([(*r, "en", "a") for r in rows], "doc_id long, text string, lang string, source string")
    out = quality.judged(df).collect()
    assert not any(r.base_failed for r in out)
    assert sorted(r.doc_id for r in out if not r.kept) == [1000 + k for k in range(len(ODD))]


def test_rows_of_which_all_are_the_same(spark):
    text = " ".join(f"word{j}" for j in range(50))
    rows = [(i, text, "en", "a") for i in range(20)] + [(99, text + " more", "en", "a"), (100, text, "de", None)]
    out = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all(r.kept for r in out) and len(out) == 22


def test_empty(no_docs):
    assert quality.judged(no_docs).count() == 0
