from __future__ import annotations

import random

from phaseflow.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(90)] + [(7, 7), (None, 3), (4, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == brute(edges)


def test_strings_and_none(spark):
    got = components(spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "b")], "a string, b string"))
    assert {r.node: r.component for r in got.collect()} == {"a": "a", "b": "a", "c": "a"}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
