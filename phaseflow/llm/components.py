"""Connected components of a distributed edge list.

Large-star and small-star steps alternate until nothing changes. A step is a minimum per node (summed up map-side) and
one join of the edges with these minima, each from a written table, so Spark can split a node with very many edges at
run time. Each step ends in a written table: lineage stays short and a lost executor costs running tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseflow.llm.scratch import dropped, written

A, B, M = "__a", "__b", "__m"


def _star(least_of: DataFrame, moved: DataFrame, tag: str) -> DataFrame:
    """Joins ``moved`` (a, b) with the least node that each a sees in ``least_of`` (a, b), itself included: (b, least)."""
    least = written(least_of.groupBy(A).agg(F.min(B).alias(M)).select(A, F.least(A, M).alias(M)), f"{tag}-least")
    hung = moved.join(least, A).select(F.col(B).alias(A), F.col(M).alias(B))
    if tag == "cc-small":
        hung = hung.union(least.select(A, F.col(M).alias(B)))
    out = written(hung.filter(F.col(A) > F.col(B)).distinct(), tag)
    dropped(least)
    return out


def _flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col(B).alias(A), F.col(A).alias(B))


def _large_star(edges: DataFrame) -> DataFrame:
    """The neighbours above each node go to the least of all its neighbours and itself."""
    return _star(edges.union(_flipped(edges)), _flipped(edges), "cc-large")


def _small_star(edges: DataFrame) -> DataFrame:
    """The neighbours below each node, and the node, go to the least of them."""
    return _star(edges, edges, "cc-small")


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(A, B)), F.sum(F.xxhash64(A, B).cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has an edge to another; the component is its least node.

    Nulls and loops link nothing. Nodes are of any one type with an order.
    """
    pairs = edges.select(F.greatest(a, b).alias(A), F.least(a, b).alias(B), (F.col(a) != F.col(b)).alias(M))
    pairs = written(pairs.filter(M).select(A, B).distinct(), "cc")
    before = _sum(pairs)
    while before[0]:
        large = _large_star(pairs)
        small = _small_star(large)
        dropped(large)
        dropped(pairs)
        pairs, after = small, _sum(small)
        if after == before:
            break
        before = after
    roots = pairs.select(B).distinct().select(F.col(B).alias("node"), F.col(B).alias("component"))
    return pairs.select(F.col(A).alias("node"), F.col(B).alias("component")).union(roots)
