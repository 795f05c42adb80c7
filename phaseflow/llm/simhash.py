"""SimHash near-dedup with BK-trees.

Fingerprints come from one pass over the texts: 64 bits, each the majority of that bit over the hashes of all 4-word
shingles. Equal fingerprints are one class, so copies never multiply. Classes link at ``RADIUS`` or fewer differing
bits; linked classes are found in BK-trees, whose children are keyed by their integer Hamming distance to the parent
and which are searched by following only edges within the radius of the distance found.

Trees are small because only candidates stand in one: the 64 bits are cut into ``blocks`` parts; two fingerprints that
differ in at most ``RADIUS`` bits agree on ``blocks - RADIUS`` whole parts at least, so one of the ways to choose that
many parts puts them in one bucket. This loses no link. ``blocks`` grows with the number of classes and with it the
number of bits that a bucket shares. A bucket larger than ``SHARD`` is dealt to shards: a tree for each, searched
with the members of each shard from its own on, a task per pair of shards. A task reports its links as a forest, at
most one edge a fingerprint and cell, and components are found distributed.

Cases: a null or empty text, or one of blanks, has the fingerprint zero, which links like any other; a text of fewer
than four words has one shingle, all its words; shingles are hashed in chunks, so a very long text needs no more memory
than its words; repeated rows are rows of their own with one component; an empty table gives an empty result; extra
columns stay out of the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseflow.llm import worker
from phaseflow.llm.buckets import dealt, gathered, whole_cells
from phaseflow.llm.components import components
from phaseflow.llm.scratch import written

SHINGLE = 4
SEED = 42
RADIUS = 4
SHARD = 2048
#: A bucket is expected to hold fewer random fingerprints than this.
BUCKET = 4096
CHUNK = 1 << 16
#: Queries that walk the trees together.
WALK = 1 << 14
#: Bits of a wide fingerprint, of which the first ``TREE`` go into trees; random fingerprints that a part's bucket is
#: expected to hold; share of pairs at the similarity asked for that no part puts into one bucket.
WIDE, TREE, CROWD, MISS = 256, 128, 16, 0.01
#: Standard deviations above the expected number of differing bits that a radius reaches.
REACH = 3.5


def majority(h: np.ndarray) -> np.ndarray:
    """For rows of unsigned words: words whose bits are set in over half the rows."""
    n, words = h.shape
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, n, CHUNK):
        some = np.ascontiguousarray(h[at : at + CHUNK], "<u8")
        lanes = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little").view(np.uint64)  # eight counters a word
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        ones += sums.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view("<u8")


def fingerprint(text: bytes) -> int:
    """Fingerprint of a text in UTF-8; ASCII letters are lower-cased, words part at ASCII blanks."""
    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(plain[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts))
    return int(majority(h[:, None])[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.enter("simhash")
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        fps = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def blocks_for(classes: int) -> int:
    """Least number of parts whose buckets are expected to hold fewer than ``BUCKET`` random fingerprints."""
    for m in range(RADIUS + 1, 3 * RADIUS):
        if classes / 2 ** (64 * (m - RADIUS) // m) < BUCKET:
            return m
    return 3 * RADIUS


def _keys(fp: Column, m: int) -> Column:
    """Array of (way, key): the bits of ``fp`` in the parts that each way chooses."""
    cuts = [64 * i // m for i in range(m + 1)]
    out = []
    for way, parts in enumerate(itertools.combinations(range(m), m - RADIUS)):
        mask = sum(((1 << (cuts[p + 1] - cuts[p])) - 1) << cuts[p] for p in parts)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(way).alias("way"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*out)


class Forest:
    """BK-trees over fingerprints (rows of words), one for each run of equal ``cell``; built and searched level by level."""

    def __init__(self, fp: np.ndarray, cell: np.ndarray, radius: int = RADIUS):
        self.fp, self.radius, self.bits = fp, radius, 64 * fp.shape[1]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.cells, self.roots = cell[first], first
        item = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        parent = first[np.searchsorted(self.cells, cell[item])]
        keys, child = [], []
        while len(item):
            key = parent * (self.bits + 1) + distance(fp[item], fp[parent])
            unique, at, of = np.unique(key, return_index=True, return_inverse=True)
            keys.append(unique)
            child.append(item[at])
            rest = np.ones(len(item), bool)
            rest[at] = False
            item, parent = item[rest], item[at][of[rest]]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.child = self.keys[order], (np.concatenate(child)[order] if child else np.zeros(0, np.int64))

    def near(self, fp: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, some at a time."""
        at = np.searchsorted(self.cells, cell)
        at[at == len(self.cells)] = 0
        asked = np.flatnonzero(self.cells[at] == cell) if len(self.cells) else np.zeros(0, np.int64)
        for begin in range(0, len(asked), WALK):
            q = asked[begin : begin + WALK]
            node = self.roots[at[q]]
            while len(q):
                d = distance(fp[q], self.fp[node])
                hit = d <= self.radius
                yield q[hit], node[hit]
                base = node * (self.bits + 1)
                low = np.searchsorted(self.keys, base + np.maximum(d - self.radius, 1), "left")
                n = np.searchsorted(self.keys, base + np.minimum(d + self.radius, self.bits), "right") - low
                q = np.repeat(q, n)
                node = self.child[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(q))]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row."""
    return sum(np.bitwise_count(a[:, k] ^ b[:, k]).astype(np.int64) for k in range(a.shape[1]))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least reachable number for each of ``n`` nodes, pairs taken in as they come."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    return label


def _links(radius: int):
    """Rows (way, key, i, j, shard, node, words of the fingerprint) of whole cells to edges (a, b) between nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(batches, CELL):
            way, key, i, j, shard, node, *fp = (c.to_numpy() for c in t.columns)
            new = (way[1:] != way[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            cell, fp = np.concatenate(([0], np.cumsum(new))), np.stack(fp, 1).view(np.uint64)
            built, asked = np.flatnonzero(shard == i), np.flatnonzero(shard == j)
            forest = Forest(fp[built], cell[built], radius)
            label = spanning(len(fp), ((asked[q], built[n]) for q, n in forest.near(fp[asked], cell[asked])))
            moved = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return run


CELL = ["way", "key", "i", "j"]


def _linked(keyed: DataFrame, words: int, radius: int, shard: int, tag: str) -> DataFrame:
    """Edges (a, b) between ``node`` of rows (way, key, node, w0, ...) that share a bucket and are within the radius."""
    cells = dealt(keyed, ["way", "key"], F.col("node"), shard, tag).select(*CELL, "shard", "node", *[f"w{k}" for k in range(words)])
    return written(gathered(cells, CELL).mapInArrow(_links(radius), "a long, b long"), f"{tag}-links", 1 << 14)


def links(classes: DataFrame, n: int, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp``; their components are those of all links."""
    keyed = classes.select("fp", F.explode(_keys(F.col("fp"), blocks_for(n))).alias("k"))
    return _linked(keyed.select("k.way", "k.key", F.col("fp").alias("node"), F.col("fp").alias("w0")), 1, RADIUS, shard, "simhash")


def differing(similar: float) -> float:
    """Share of bits in which two sets differ that have this Jaccard similarity and one size: an angle over pi."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def radius(similar: float, bits: int) -> int:
    """Differing bits, of ``bits``, that hardly any pair at ``similar`` exceeds."""
    share = differing(similar)
    return math.ceil(bits * share + REACH * math.sqrt(bits * share * (1 - share)))


@lru_cache(maxsize=64)
def ways_for(bits: int, similar: float) -> int:
    """Least number of parts of ``bits`` bits that keep all but ``MISS`` of the pairs at ``similar``."""
    share = differing(similar)
    chance = [math.comb(WIDE, d) * share**d * (1 - share) ** (WIDE - d) for d in range(WIDE + 1)]
    agree = [math.comb(WIDE - d, bits) / math.comb(WIDE, bits) for d in range(WIDE + 1)]
    ways = 1
    while sum(c * (1 - a) ** ways for c, a in zip(chance, agree, strict=True)) > MISS:
        ways += 1
    return ways


def _parts(bits: int, ways: int):
    """Rows (node, words of the wide fingerprint) to (way, key, node, words in trees), ``ways`` rows each."""
    rng = np.random.default_rng([SEED, bits, ways])
    drawn = np.stack([rng.permutation(WIDE)[:bits] for _ in range(ways)])
    weight = 1 << np.arange(bits, dtype=np.int64)
    names = ["way", "key", "node", *[f"w{k}" for k in range(TREE // 64)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = np.stack([c.to_numpy() for c in b.columns[1:]], 1)
            on = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
            key = np.stack([on[:, d] @ weight for d in drawn], 1).ravel()
            way = np.tile(np.arange(ways, dtype=np.int16), len(words))
            yield pa.RecordBatch.from_arrays([pa.array(way), pa.array(key.astype(np.int32)), *(pa.array(np.repeat(c.to_numpy(), ways)) for c in b.columns[: 1 + TREE // 64])], names)

    return run


def wide_links(classes: DataFrame, n: int, similar: float, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between ``node`` of ``n`` classes (node, w0, w1, ...) whose fingerprints differ as little as those of
    sets with this Jaccard similarity: candidates, a forest for each bucket."""
    bits = min(24, max(6, math.ceil(math.log2(max(1, n) / CROWD))))
    words = ", ".join(f"w{k} long" for k in range(TREE // 64))
    rows = classes.select("node", *[f"w{k}" for k in range(WIDE // 64)])
    keyed = rows.mapInArrow(_parts(bits, ways_for(bits, similar)), f"way short, key int, node long, {words}")
    return _linked(keyed, TREE // 64, radius(similar, TREE), shard, "simhash-wide")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id column, fp, component_id) of each row; the component is the least id reachable by links, itself included."""
    rows = written(fingerprints(docs, id_col, text_col), "simhash")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    member = written(components(links(classes.select("fp"), classes.count())).withColumnRenamed("node", "fp"), "simhash-members")
    least = member.join(classes, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id")
    named = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(written(named, "simhash-named"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
