"""Near copies by SimHash: texts whose sets of 5-word shingles have a Jaccard similarity of at least ``SIMILAR``.

Words are those of ``simhash``. Equal sets are one class, so copies never multiply. Each class has a wide fingerprint of
its set, and the trees of ``simhash.wide_links`` find the classes whose fingerprints differ as little as those of sets at
``SIMILAR``; about one such pair in a hundred at ``SIMILAR`` exactly has no bucket in common, closer ones far less often.
Classes that candidates connect meet in one cell, where every pair within the radius and not yet linked is decided by the
exact similarity of its shingles; only what passes is a link. A component of more than ``SHARD`` classes or ``CELL_CHARS``
characters is dealt to shards, a cell for each pair of these.

Cases: null and empty texts and texts of blanks have the empty set and are one class; a text of fewer than five words
has one shingle, all its words; a null id comes after all others; repeated rows are copies; an empty table gives an empty
result; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phaseflow.llm import simhash, worker
from phaseflow.llm.components import components
from phaseflow.llm.scratch import written

SHINGLE = 5
SIMILAR = 0.8
SHARD, CELL_CHARS = 2048, 1 << 24
SEED = 43
WORDS = [f"w{k}" for k in range(simhash.WIDE // 64)]

#: One fixed odd number and one mask for each word of a fingerprint.
_rng = np.random.default_rng(SEED)
_MASK = _rng.integers(0, 1 << 63, len(WORDS), np.uint64)
_TIMES = _rng.integers(0, 1 << 63, len(WORDS), np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    plain = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(plain[s:e], SEED) for s, e in spans), np.uint64, len(words) - k + 1))


def wide(found: np.ndarray) -> np.ndarray:
    """Wide fingerprint of a set of shingles: independent words of each hash, the majority of every bit."""
    if not len(found):
        return np.zeros(len(WORDS), np.uint64)
    h = (found[:, None] ^ _MASK) * _TIMES
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return simhash.majority(h ^ (h >> np.uint64(29)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``SIMILAR``."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker.enter("near copies")
    for batch in batches:
        same, words = [], []
        for t in batch.column(2).cast(pa.large_binary()):
            found = shingles(t.as_py() or b"")
            same.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            words.append(wide(found))
        fp = np.array(words, np.uint64).reshape(-1, len(WORDS)).view(np.int64)
        cols = [batch.column(0), batch.column(1), pa.array(np.array(same, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)]
        yield pa.RecordBatch.from_arrays(cols, ["id", "h", "same", *WORDS])


def _verified(cell: pa.Table) -> pa.Table:
    """Edges (a, b) of one cell: a forest of the pairs within the radius that are similar."""
    cell = cell.sort_by("same")
    same, shard = cell["same"].to_numpy(), cell["shard"].to_numpy()
    across = cell["i"][0].as_py() != cell["j"][0].as_py()
    fp = np.stack([cell[c].to_numpy() for c in WORDS], 1).view(np.uint64)
    radius = simhash.radius(SIMILAR, simhash.WIDE)
    sets = [shingles(t.as_py() or b"") for t in cell["text"].cast(pa.large_binary())]
    label = np.arange(len(same))
    for x in range(1, len(same)):
        near = (np.bitwise_count(fp[:x] ^ fp[x]).sum(1) <= radius) & (label[:x] != label[x])
        if across:
            near &= shard[:x] != shard[x]
        for y in np.flatnonzero(near).tolist():
            if label[y] != label[x] and similar(sets[x], sets[y]):
                least, most = sorted((label[x], label[y]))
                label[label == most] = least
    moved = np.flatnonzero(label != np.arange(len(same)))
    return pa.table({"a": same[moved], "b": same[label[moved]]})


def links(classes: DataFrame, docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between ``same`` of classes (same, id, h, words); ``docs`` (id, h, text) has their texts."""
    found = simhash.wide_links(classes.select(F.col("same").alias("node"), *WORDS), classes.count(), SIMILAR)
    cand = written(components(found).withColumnRenamed("node", "same"), "near-candidates")
    member = written(cand.join(classes, "same"), "near-members")
    match = docs["h"].eqNullSafe(member["h"]) & docs["id"].eqNullSafe(member["id"])
    rows = docs.join(member.hint("shuffle_hash"), match).select("same", "component", *WORDS, "text").dropDuplicates(["same"])
    rows = written(rows, "near-texts")
    size = rows.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / shard), F.ceil(F.sum(F.length("text")) / CELL_CHARS)).cast("int").alias("parts"))
    size = written(size.filter("parts > 1"), "near-large")
    rows = rows.join(size, "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("shard")).alias("i"), F.greatest(x, F.col("shard")).alias("j")))
    cells = rows.select("same", "component", "shard", *WORDS, "text", F.explode(own).alias("c"))
    return written(cells.select("same", "component", "shard", *WORDS, "text", "c.i", "c.j").groupBy("component", "i", "j").applyInArrow(_verified, "a long, b long"), "near-links")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, lead_id, lead_h) of each row, ``h`` the hash of its text: the least row reachable by links, itself included."""
    texts = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    words = ", ".join(f"{w} long" for w in WORDS)
    rows = written(texts.mapInArrow(_signed, f"id {texts.schema['id'].dataType.simpleString()}, h long, same long, {words}"), "near")
    lead = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    classes = written(rows.groupBy("same").agg(F.min(lead).alias("lead"), *[F.first(w).alias(w) for w in WORDS]), "near-classes")
    edges = links(classes.select("same", "lead.id", "lead.h", *WORDS), texts)
    member = written(components(edges).withColumnRenamed("node", "same"), "near-linked")
    leads = classes.select("same", "lead")
    least = member.join(leads, "same").groupBy("component").agg(F.min("lead").alias("first"))
    named = leads.join(member.join(least, "component").select("same", "first"), "same", "left")
    named = written(named.select("same", F.coalesce("first", "lead").alias("lead")), "near-named")
    return rows.join(named, "same").select("id", "h", F.col("lead.id").alias("lead_id"), F.col("lead.h").alias("lead_h"))
