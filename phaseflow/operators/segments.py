"""Segment scores, their fusion over features, and the best division of a flow into phases.

The score of a stretch of packets is 1 / (sample variance + smoothing). Scores of several features are each divided by
their greatest value, weighted and summed; a single packet scores the regularization alone. A division into p phases
maximizes the sum of its stretches' scores; of equal divisions the one with the earliest cuts wins.

The relational form (:func:`moments`, :func:`scored`, :func:`fused`) shows every stretch as a row and serves inspection
and tests. The kernel (:func:`divide`) does all of it for one flow and for every number of phases at once, so no matrix
leaves the worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING = 1e-3
REGULARIZATION = 1e-3
#: A feature whose greatest score is not above this takes no part.
FLAT = 1e-6


def score_matrix(x: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Score of the stretch from row to column; 0 on and below the diagonal."""
    n = len(x)
    out = np.zeros((n, n))
    if np.array_equal(x, np.rint(x)) and np.abs(x).max(initial=0) < 2**20:
        whole = x.astype(np.int64)  # exact moments
        s, q = (np.concatenate(([0], np.cumsum(v))) for v in (whole, whole * whole))
        for t in range(1, n):
            count = t + 1 - np.arange(t)
            total, square = s[t + 1] - s[:t], q[t + 1] - q[:t]
            out[:t, t] = 1 / ((square - (total * total) / count) / (count - 1) + smoothing)
        return out
    mean, spread = np.zeros(n), np.zeros(n)
    for t in range(n):  # running moments of the stretches from every start, in step
        count = t + 1 - np.arange(t + 1)
        delta = x[t] - mean[: t + 1]
        mean[: t + 1] += delta / count
        spread[: t + 1] += delta * (x[t] - mean[: t + 1])
        out[:t, t] = 1 / (spread[:t] / (count[:t] - 1) + smoothing)
    return out


def fused_matrix(arrays: Sequence[np.ndarray], weights: Sequence[float], smoothing: Sequence[float], regularization: float = REGULARIZATION) -> np.ndarray:
    total = np.zeros((len(arrays[0]),) * 2)
    for x, w, s in zip(arrays, weights, smoothing, strict=True):
        scores = score_matrix(np.asarray(x, float), s)
        greatest = scores.max(initial=0)
        if greatest > FLAT:
            total += w * (scores / greatest)
    total[np.diag_indices(len(total))] += regularization
    return total


def divisions(fused: np.ndarray, most: int) -> dict[int, list[int]]:
    """For each number of phases from 2 to ``most`` that fits: the ends of all phases but the last, counted from 1."""
    n = len(fused)
    best = np.full(n + 1, -np.inf)
    best[1:] = fused[0]
    origin: list[np.ndarray] = [np.zeros(n + 1, int)] * 2
    out = {}
    ends = np.triu(np.ones((n, n), bool))  # a stretch from j ends at t >= j
    for k in range(2, min(most, n) + 1):
        total = np.where(ends, best[:n, None] + fused, -np.inf)
        total[: k - 1] = -np.inf
        origin.append(np.concatenate(([0], total.argmax(0))))  # the first of equals
        best = np.concatenate(([-np.inf], total.max(0)))
        marks, t = [], n
        for level in range(k, 1, -1):
            t = int(origin[level][t])
            marks.append(t)
        out[k] = marks[::-1]
    return out


def divide(sequences: DataFrame, phases: Sequence[int], weights: Mapping[str, float], smoothing: Mapping[str, float] | None = None, regularization: float = REGULARIZATION, max_length: int = 1000, keys: Sequence[str] = ("flow_id",)) -> DataFrame:
    """(keys, num_phases, marks) for each flow and number of phases that it is long enough for.

    ``weights`` names the features, arrays in columns of their names. Flows with missing or infinite values have none.
    """
    names = list(weights)
    wanted = sorted({p for p in phases if p > 1})
    least = [(smoothing or {}).get(n, SMOOTHING) for n in names]
    factor = [weights[n] for n in names]
    types = [f"`{k}` {sequences.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, num, marks = [], [], []
            columns = [batch.column(len(keys) + i) for i in range(len(names))]
            for row in range(batch.num_rows):
                arrays = [np.array(c[row].as_py() or [], float)[:max_length] for c in columns]
                if len(arrays[0]) < 2 or not all(np.isfinite(a).all() for a in arrays):
                    continue
                found = divisions(fused_matrix(arrays, factor, least, regularization), max(wanted))
                for p in wanted:
                    if p in found:
                        at.append(row)
                        num.append(p)
                        marks.append(found[p])
            ids = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(num, pa.int32()), pa.array(marks, pa.list_(pa.int32()))], [*keys, "num_phases", "marks"])

    return sequences.filter(F.size(names[0]) >= 2).select(*keys, *names).mapInArrow(run, ", ".join([*types, "num_phases int", "marks array<int>"]))


def _stretches(sequences: DataFrame, names: Sequence[str], columns: Mapping[str, object], keys: Sequence[str], max_length: int) -> DataFrame:
    """(keys, s, t, columns) of every stretch of each flow; a column is a function of the flow's arrays to a matrix."""
    types = [f"`{k}` {sequences.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                arrays = [np.array(batch.column(len(keys) + i)[row].as_py() or [], float)[:max_length] for i in range(len(names))]
                if not len(arrays[0]) or not all(np.isfinite(a).all() for a in arrays):
                    continue
                made = {c: f(arrays) for c, f in columns.items()}
                s, t = np.triu_indices(len(arrays[0]))
                for at in range(0, len(s), 1 << 16):  # a long flow has many stretches
                    i, j = s[at : at + (1 << 16)], t[at : at + (1 << 16)]
                    ids = [batch.column(k).take(pa.array(np.full(len(i), row))) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(m[i, j]) for m in made.values())], [*keys, "s", "t", *made])

    return sequences.select(*keys, *names).mapInArrow(run, ", ".join([*types, "s int", "t int", *(f"{c} double" for c in columns)]))


def _mean_matrix(x: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(x)))
    n = np.arange(len(x))
    return (total[None, 1:] - total[:-1, None]) / np.maximum(1, n[None, :] - n[:, None] + 1)


def matrix_rows(sequences: DataFrame, feature: str, smoothing: float = SMOOTHING, max_length: int = 1000, keys: Sequence[str] = ("pcap", "flow_id")) -> DataFrame:
    """(keys, s, t, u, j): mean and score of every stretch of one feature, ready to be written as a table by flow."""
    return _stretches(sequences, [feature], {"u": lambda a: _mean_matrix(a[0]), "j": lambda a: score_matrix(a[0], smoothing)}, keys, max_length)


def fused_rows(sequences: DataFrame, weights: Mapping[str, float], smoothing: Mapping[str, float] | None = None, regularization: float = REGULARIZATION, max_length: int = 1000, keys: Sequence[str] = ("pcap", "flow_id")) -> DataFrame:
    """(keys, s, t, fused) of every stretch, single packets too."""
    least = [(smoothing or {}).get(n, SMOOTHING) for n in weights]
    return _stretches(sequences, list(weights), {"fused": lambda a: fused_matrix(a, list(weights.values()), least, regularization)}, keys, max_length)


def moments(packets: DataFrame, feature: str, keys: Sequence[str] = ("flow_id",), order: str = "pos") -> DataFrame:
    """(keys, s, t, n, total, square): moments of the integer ``feature`` over each stretch of two packets or more."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(feature).cast("long")
    run = packets.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).alias("i"), x.alias("x"), F.sum(x).over(w).alias("sx"), F.sum(x * x).over(w).alias("sq"))
    a = run.select(*keys, F.col("i").alias("s"), (F.col("sx") - F.col("x")).alias("sx0"), (F.col("sq") - F.col("x") * F.col("x")).alias("sq0"))
    b = run.select(*keys, F.col("i").alias("t"), "sx", "sq")
    pairs = a.join(b, list(keys)).filter(F.col("s") < F.col("t"))
    n = (F.col("t") - F.col("s") + 1).cast("double")
    return pairs.select(*keys, "s", "t", n.alias("n"), (F.col("sx") - F.col("sx0")).alias("total"), (F.col("sq") - F.col("sq0")).alias("square"))


def scored(stretches: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Adds u (mean), m (sum of squared deviations) and j (score)."""
    deviation = F.col("square").cast("double") - (F.col("total") * F.col("total")).cast("double") / F.col("n")
    df = stretches.withColumn("u", F.col("total") / F.col("n")).withColumn("m", deviation)
    return df.withColumn("j", F.lit(1.0) / (F.col("m") / (F.col("n") - 1) + smoothing))


def fused(scores: Mapping[str, DataFrame], weights: Mapping[str, float], keys: Sequence[str] = ("flow_id",)) -> DataFrame:
    """(keys, s, t, fused) from one frame of scores a feature."""
    parts = []
    for name, df in scores.items():
        greatest = F.max("j").over(Window.partitionBy(*keys))
        share = F.when(greatest > FLAT, weights[name] * (F.col("j") / greatest)).otherwise(0.0)
        parts.append(df.select(*keys, "s", "t", share.alias(f"share_{name}")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [*keys, "s", "t"])
    total = F.lit(0.0)
    for name in scores:
        total = total + F.col(f"share_{name}")
    return out.select(*keys, "s", "t", total.alias("fused"))
