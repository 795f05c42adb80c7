from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

from phaseflow.llm import simhash
from phaseflow.llm.simhash import spanning


def plain(text: str | None) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps: dict[int, int]) -> dict[int, int]:
    ids = sorted(fps)
    pairs = [(x, y) for x in range(len(ids)) for y in range(x) if (fps[ids[x]] ^ fps[ids[y]]).bit_count() <= 4]
    label = spanning(len(ids), iter([tuple(np.array(c) for c in zip(*pairs, strict=True))]))
    return {i: ids[label[k]] for k, i in enumerate(ids)}


def test_documents(spark, docs, texts):
    fps = {r[0]: plain(r[1]) for r in texts}
    want = brute(fps)
    out = simhash.near_duplicates(docs).withColumn("hex", simhash.as_hex(simhash.F.col("fp"))).collect()
    assert {r.doc_id: (r.hex, r.component_id) for r in out} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(out) == len(texts)
    assert len(set(want.values())) < len(want)


def test_links_in_shards_and_every_number_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 30)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, k, replace=False)) for c in centres for k in rng.integers(0, 6, 12)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute(dict(enumerate(fps)))
    for m in (5, 6, 7, 8):
        monkeypatch.setattr(simhash, "blocks_for", lambda n, m=m: m)
        edges = simhash.links(df, len(fps), shard=5).collect()
        place = {f: k for k, f in enumerate(fps)}
        assert all((e.a ^ e.b).bit_count() <= 4 or want[place[e.a]] == want[place[e.b]] for e in edges)
        label = spanning(len(fps), iter([(np.array([place[e.a] for e in edges]), np.array([place[e.b] for e in edges]))]))
        assert label.tolist() == [want[k] for k in range(len(fps))]


def test_forest_is_exact():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64))
    cell = np.zeros(len(fp), np.int64)
    found = set()
    for q, n in simhash.Forest(fp[:, None], cell).near(fp[:, None], cell):
        found |= set(zip(q.tolist(), n.tolist(), strict=True))
    assert found == {(a, b) for a in range(len(fp)) for b in range(len(fp)) if int(fp[a] ^ fp[b]).bit_count() <= 4}


def test_wide_forest_is_exact():
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, (6, 2)).astype(np.uint64)
    flips = np.packbits(rng.random((300, 128)) < 0.12, axis=1, bitorder="little").view(np.uint64)
    fp, cell = centre[rng.integers(0, 6, 300)] ^ flips, np.sort(rng.integers(0, 3, 300))
    near = lambda a, b: cell[a] == cell[b] and sum(int(x).bit_count() for x in fp[a] ^ fp[b]) <= 30
    found = [p for q, n in simhash.Forest(fp, cell, 30).near(fp, cell) for p in zip(q.tolist(), n.tolist(), strict=True)]
    assert sorted(found) == [(a, b) for a in range(300) for b in range(300) if near(a, b)]


def test_parts_keep_what_they_promise():
    """Fingerprints of pairs at the similarity share a part as often as asked for, at several sizes."""
    rng = np.random.default_rng(3)
    for bits in (8, 14):
        ways = simhash.ways_for(bits, 0.8)
        a = rng.integers(0, 1 << 63, (400, 4)).astype(np.uint64)
        b = a ^ np.packbits(rng.random((400, 256)) < simhash.differing(0.8), axis=1, bitorder="little").view(np.uint64)
        keys = []
        for x in (a, b):
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(400)), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in x.T)], ["node", "w0", "w1", "w2", "w3"])
            out = next(simhash._parts(bits, ways)(iter([batch])))
            keys.append(out.column("key").to_numpy().reshape(400, ways))
        assert (keys[0] == keys[1]).any(1).mean() > 0.97
        assert (np.bitwise_count(a[:, :2] ^ b[:, :2]).sum(1) <= simhash.radius(0.8, simhash.TREE)).mean() > 0.99


def test_majority_counts_any_number_of_rows():
    rng = np.random.default_rng(4)
    for n in (1, 2, 254, 255, 256, 1000):
        h = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[:, w]) > n) for w in range(2)]
        assert simhash.majority(h).tolist() == want


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
