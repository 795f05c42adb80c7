from __future__ import annotations

import re
from collections import defaultdict

from phaseflow.llm import mixing


def filled(sizes: list[tuple[str, int]]) -> dict:
    """Targets by sharing the excess out again and again."""
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(sizes)}
    cap = {s: 3 * n for s, n in sizes}
    total, full = sum(n for _, n in sizes), {}
    while True:
        left = total - sum(full.values())
        open_ = [s for s, _ in sizes if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            return full | share
        full |= {s: cap[s] for s in over}


def test_targets_and_copies(docs, texts, spark):
    out = mixing.mix(docs).collect()
    assert len(out) == len(texts)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in texts}
    by = defaultdict(int)
    for r in texts:
        by[r[3]] += size[r[0]]
    want = filled(sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")))
    taken = defaultdict(int)
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s in by:
        assert abs(taken[s] - want[s]) <= max(size.values())
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)


def test_close_to_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), f"s{min(i % 17, 5)}") for i in range(6000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = out.groupBy("source").agg(mixing.F.sum(mixing.F.col("copies") * mixing.F.col("size")).alias("t"), mixing.F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) < 0.01 * r.g for r in sums)


def test_emitted(docs):
    """Each row as often as the mixture takes it, rows that are the same as often as all of them."""
    mixed = mixing.mix(docs)
    assert mixing.emitted(docs, mixed).count() == sum(r.copies for r in mixed.collect())


def test_empty(no_docs, spark):
    assert mixing.mix(no_docs).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target) for r in mixing.mix(nothing).collect()] == [(0, 0.0)] * 2
