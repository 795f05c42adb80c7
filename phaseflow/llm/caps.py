"""Embedding near-dedup with spherical-cap filters.

A filter is a direction; a vector passes it if their product reaches a threshold, that is, if the vector lies in a
spherical cap around it. Directions are structured: after one of ``CODES`` random rotations, a direction joins one word
of a random codebook for each half of the dimensions, so the words' products with the halves of a vector are computed
once and all exceeding directions are list-decoded from their sums. Vectors of one label that pass a common filter are
candidates, and candidates are verified in double precision.

The threshold is that which an expected ``EXPECTED`` directions of a code exceed; it comes from random unit vectors,
not from the data, and takes no more memory than the codebooks. With 12 codes of 4, two vectors at the least similarity linked have a common filter in 99.9 % of
cases and closer ones more often. Codebooks grow with the largest label, so that buckets stay small.

Equal vectors are one class and are counted by their number, never paired. Buckets first hold 128 signs of random
projections instead of vectors; rows without a candidate at ``SIGNS`` or fewer differing signs leave them, so vectors
are sent only to buckets where they have one. A pair is counted in the least of the filters that its vectors share
there, so no list of pairs is made: a bucket reports a count for each vector and at most one edge. Buckets above
``SHARD`` rows are dealt to cells.

Cases: a null id, vector or label, a vector of zeros, without elements, or with null or non-finite elements links with
nothing and is its own component; of different vectors with one id each row has the links of all; vectors of different dimensions do not link; repeated rows are copies; an empty table
gives an empty result; extra columns stay out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phaseflow.llm.buckets import dealt, gathered, whole_cells
from phaseflow.llm.components import components
from phaseflow.llm.scratch import written
from phaseflow.llm.simhash import spanning

COSINE = 0.93
CODES, EXPECTED = 12, 4
#: Random projections of a vector's signature, and the most that may differ: linked pairs differ in 15 +- 4 at most.
SIGNATURE, SIGNS = 128, 38
SHARD = 1024
SEED = 7
#: Rows with vectors that a task takes at a time, if whole cells allow it.
VECTORS = 1 << 13
#: Words times random vectors from which the threshold comes.
PROBED = 1 << 16
#: Distance between neighbours in a sorted bucket up to which whole columns are compared at once.
SHIFTS = 32


class Code:
    """Rotations, codebooks and threshold for vectors of ``dims`` dimensions; the same wherever they are made."""

    def __init__(self, dims: int, words: int):
        rng = np.random.default_rng([SEED, dims, words])
        self.dims, self.words = dims, words
        halves = [h for h in np.array_split(np.arange(dims), 2) if len(h)]
        self.turns = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(CODES)]
        self.books = []
        for _ in range(CODES):
            book = []
            for h in halves:
                c = rng.standard_normal((words, len(h)))
                book.append((h, c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(len(h) / dims)))
            self.books.append(book)
        self.per_code = words ** len(halves)
        self.threshold = self._threshold(rng)
        self.planes = rng.standard_normal((dims, SIGNATURE))

    @staticmethod
    @lru_cache(maxsize=8)
    def of(dims: int, words: int) -> Code:
        return Code(dims, words)

    def _threshold(self, rng: np.random.Generator) -> float:
        """What ``EXPECTED`` directions of a code exceed on average over random unit vectors.

        Sums of two halves' products are counted above a limit from the sorted products, and the limit is found by
        halving, so the product of the two codebooks is never made.
        """
        probes = max(8, min(64, PROBED // self.words))
        x = rng.standard_normal((CODES * probes, self.dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        parts = []
        for k in range(CODES):
            y = x[k * probes : (k + 1) * probes] @ self.turns[k]
            parts += zip(*([np.sort(row) for row in y[:, h] @ book.T] for h, book in self.books[k]), strict=True)
        wanted, low, high = EXPECTED * len(parts), -2.0, 2.0
        while high - low > 1e-9:
            limit = (low + high) / 2
            if sum(_exceeding(p, limit) for p in parts) > wanted:
                low = limit
            else:
                high = limit
        return low if self.per_code > EXPECTED else -2.0

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every direction that a unit vector exceeds."""
        rows, filters = [], []
        for code in range(CODES):
            y = x @ self.turns[code]
            parts = [y[:, h] @ book.T for h, book in self.books[code]]
            if len(parts) == 1:
                r, f = np.nonzero(parts[0] >= self.threshold)
            else:
                order = np.argsort(-parts[1], axis=1)
                ranked = np.take_along_axis(parts[1], order, 1)
                r, a = np.nonzero(parts[0] + ranked[:, :1] >= self.threshold)
                found = [(r[:0], r[:0])]
                for depth in range(self.words):  # the second halves in falling order, as long as any sum exceeds
                    on = parts[0][r, a] + ranked[r, depth] >= self.threshold
                    r, a = r[on], a[on]
                    if not len(r):
                        break
                    found.append((r, a * self.words + order[r, depth]))
                r, f = (np.concatenate(z) for z in zip(*found, strict=True))
            rows.append(r)
            filters.append(f + code * self.per_code)
        return np.concatenate(rows), np.concatenate(filters)

    def signature(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bits = np.packbits(x @ self.planes > 0, axis=1).view(np.int64)
        return bits[:, 0], bits[:, 1]


def _exceeding(parts: tuple[np.ndarray, ...], limit: float) -> int:
    """Number of sums of one value of each (sorted) part that reach ``limit``."""
    if len(parts) == 1:
        return len(parts[0]) - int(np.searchsorted(parts[0], limit))
    a, b = parts
    return len(a) * len(b) - int(np.searchsorted(b, limit - a[::-1]).sum())


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(words: int):
    """Rows (id, label, dims, v) to (label, dims, filter, id, s1, s2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, labels, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for d in np.unique(dims).tolist():
                of = np.flatnonzero(dims == d)
                code, x = Code.of(d, words), _units(_matrix(b.column(3).take(pa.array(of)), d))
                r, f = code.decode(x)
                s1, s2 = code.signature(x)
                cols = [labels[of][r], dims[of][r], f.astype(np.int64), ids[of][r], s1[r], s2[r]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["label", "dims", "filter", "id", "s1", "s2"])

    return run


CELL = ["label", "dims", "filter", "i", "j"]


def _bounds(t: pa.Table) -> np.ndarray:
    """Bounds of the runs of equal cells."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in CELL:
        value = t.column(k).to_numpy()
        new |= value[1:] != value[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [t.num_rows]))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, filter) of rows that have another at few differing signs in their cell."""
    for t in whole_cells(batches, CELL):
        near = _near(t, _bounds(t))
        yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[near]) for c in ("id", "filter")], ["id", "filter"])


def _near(t: pa.Table, bounds: np.ndarray) -> np.ndarray:
    """Whether each row has another at few differing signs in its cell."""
    s1, s2, shard, i, j = (t.column(k).to_numpy() for k in ("s1", "s2", "shard", "i", "j"))
    s1, s2 = s1.view(np.uint64), s2.view(np.uint64)  # bits of signed numbers are counted in their absolute value
    size = np.diff(bounds)
    end, near = np.repeat(bounds[1:], size), np.zeros(t.num_rows, bool)
    small = np.repeat(size <= SHIFTS, size)
    at = np.flatnonzero(small)
    for shift in range(1, SHIFTS):
        at = at[at + shift < end[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count(s1[at] ^ s1[at + shift]) + np.bitwise_count(s2[at] ^ s2[at + shift]) <= SIGNS]
        near[hit] = near[hit + shift] = True
    for k in np.flatnonzero(size > SHIFTS).tolist():
        lo, hi = bounds[k], bounds[k + 1]
        a, b = (lo + np.flatnonzero(shard[lo:hi] == i[lo]), lo + np.flatnonzero(shard[lo:hi] == j[lo]))
        for begin in range(0, len(a), 256):
            x = a[begin : begin + 256]
            close = np.bitwise_count(s1[x][:, None] ^ s1[b]) + np.bitwise_count(s2[x][:, None] ^ s2[b]) <= SIGNS
            close &= x[:, None] != b
            near[x] |= close.any(1)
            near[b] |= close.any(0)
    return near


def _verified(cosine: float):
    """Rows (label, dims, filter, id, copies, filters, v, shard, i, j) of whole cells to (id, links, root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches, CELL, VECTORS):
            found = [x for lo, hi in itertools.pairwise(_bounds(t).tolist()) if hi - lo > 1 and (x := _cell_links(t.slice(lo, hi - lo), cosine))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["id", "links", "root"])

    return run


def _cell_links(t: pa.Table, cosine: float) -> tuple[np.ndarray, ...] | None:
    """(id, links, root) of the rows of one cell that have links which count there."""
    ids, copies, shard = (t.column(n).to_numpy() for n in ("id", "copies", "shard"))
    dims, f, i, j = (t.column(n)[0].as_py() for n in ("dims", "filter", "i", "j"))
    x = _matrix(t.column("v").combine_chunks(), dims)
    norm = np.linalg.norm(x, axis=1)
    a, b = np.flatnonzero(shard == i), np.flatnonzero(shard == j)
    hit = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b]) >= cosine
    hit &= (a[:, None] < b) if i == j else np.ones(1, bool)
    used = np.union1d(a[hit.any(1)], b[hit.any(0)])
    if not len(used):
        return None
    earlier = _shared_before(t.column("filters").combine_chunks().take(pa.array(used)), f)
    place = np.full(len(ids), -1)
    place[used] = np.arange(len(used))
    ha, hb = np.nonzero(hit)
    first = ~earlier[place[a[ha]], place[b[hb]]]
    ha, hb = a[ha[first]], b[hb[first]]
    if not len(ha):
        return None
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, ha, copies[hb])
    np.add.at(n, hb, copies[ha])
    label = spanning(len(ids), iter([(ha, hb)]))
    some = np.flatnonzero(n)
    return ids[some], n[some], ids[label[some]]


def _shared_before(lists: pa.ListArray, f: int) -> np.ndarray:
    """For each two rows: whether their lists share a filter below ``f``."""
    n = len(lists)
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    value = lists.flatten().to_numpy()
    keep = value < f
    row, value = row[keep], value[keep]
    _, value = np.unique(value, return_inverse=True)
    out = np.zeros((n, n), bool)
    for begin in range(0, int(value.max(initial=-1)) + 1, 4096):
        on = (value >= begin) & (value < begin + 4096)
        has = np.zeros((n, 4096), np.float32)
        has[row[on], value[on] - begin] = 1
        out |= has @ has.T > 0
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(id column, n_links, component_id) of each row; equal labels only, cosine at ``cosine`` or above."""
    v, label = F.col(vector_col).cast("array<double>"), F.col(label_col)
    usable = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    digest = F.sha2(F.concat_ws(",", label.cast("string"), F.transform(v, lambda x: F.when(x == 0, F.lit("0")).otherwise(x.cast("string")))), 256)
    key = F.when(F.coalesce(usable, F.lit(False)), digest)
    rows = written(vectors.select(F.col(id_col).alias("vid"), label.alias("label"), F.col(vector_col).alias("v"), key.alias("key")), "caps-rows")
    some = rows.filter(F.col("key").isNotNull())
    least = F.min_by(F.struct("label", "v"), "vid")
    classes = some.groupBy("key").agg(F.min("vid").alias("id"), F.count(F.lit(1)).alias("copies"), least.alias("of"))
    classes = classes.select("key", "id", "copies", F.col("of.label").alias("label"), F.col("of.v").alias("v"))
    classes = written(classes.withColumn("dims", F.size("v")), "caps-classes")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    words = max(8, int(np.ceil(np.sqrt(most / 2))))
    decoded = classes.select("id", F.xxhash64("label").alias("label"), "dims", "v").mapInArrow(_decoded(words), "label long, dims int, filter long, id long, s1 long, s2 long")
    decoded = written(decoded, "caps-filters")
    cells = dealt(decoded, ["label", "dims", "filter"], F.col("id"), SHARD, "caps")
    near = written(gathered(cells, CELL).mapInArrow(_candidates, "id long, filter long"), "caps-near", 1 << 16)
    sent = near.groupBy("id").agg(F.sort_array(F.collect_set("filter")).alias("filters"))
    sent = sent.join(classes.select("id", F.xxhash64("label").alias("label"), "dims", "copies", "v"), "id")
    sent = written(sent.select("label", "dims", F.explode("filters").alias("filter"), "id", "copies", "filters", "v"), "caps-sent")
    cells = dealt(sent, ["label", "dims", "filter"], F.col("id"), SHARD, "caps-sent")
    found = gathered(cells, CELL).mapInArrow(_verified(cosine), "id long, links long, root long")
    found = written(found, "caps-found", 4096)
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    member = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    named = classes.select("key", "id", "copies").join(linked, "id", "left").join(written(member, "caps-members"), "id", "left")
    named = named.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.drop("label", "v").join(written(named, "caps-named"), "key", "left")
    return out.select(F.col("vid").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vid").alias("component_id"))
