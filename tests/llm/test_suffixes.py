from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from phaseflow.llm import suffixes


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    out, seen = {}, set()
    for i in sorted({i for i, _ in rows}):
        own = [(t or "").encode() for k, t in rows if k == i]
        for b in own:
            covered = np.zeros(len(b) + 1, bool)
            for k in range(len(b) - 49):
                if b[k : k + 50] in seen:
                    covered[k : k + 50] = True
            covered = covered[: len(b)]
            spans = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
            kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
            out[i] = (len(b), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
        for b in own:
            seen.update(b[k : k + 50] for k in range(len(b) - 49))
    return out


def got(df) -> dict[int, tuple]:
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_all_cases(docs, texts):
    out = suffixes.deduplicated(docs)
    assert got(out) == brute([r[:2] for r in texts])
    assert out.count() == len(texts)


def test_many_partitions_and_text(spark, texts):
    rng = random.Random(5)
    common = "this very common line is here, it is"  # shorter than a window
    rows = [(100 + i, " ".join(rng.choice(["aa", "bb", "cc", common, common * 2]) for _ in range(12))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = suffixes.deduplicated(df, text_too=True)
        assert got(out) == brute(rows)
        for r in out.collect():
            assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_text_that_repeats_itself(spark):
    """Few suffixes, whatever the period; places are found in all of it."""
    size = 1 << 20
    for unit in ("-", "ab", "- ", "abcdefghij" * 3):
        raw = np.frombuffer((unit * size).encode()[:size], np.uint8)
        h = suffixes.anchors(raw, np.array([0, size]))[4]
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([raw.tobytes().decode()]), pa.array([np.unique(h).tobytes()]), pa.array([7])], ["id", "text", "hashes", "h"])
        out = list(suffixes._contexts(iter([batch])))
        assert sum(b.column("context").nbytes for b in out) < size // 10
        assert sum(len(p) for b in out for p in b.column("places")) == len(h)
    rows = [(1, "x" + "ab" * 3000), (2, "ab" * 2000 + "-" * 700 + "tail of the text"), (3, "-" * 300 + " some " + "-" * 60 + "ab" * 40), (4, "-" * 49), (5, ("line one of two\n" * 30 + "end") * 3), (6, "line one of two\n" * 9)]
    assert got(suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_copies_and_texts_of_one_id(spark):
    rng = random.Random(6)
    a, b, c = (" ".join(str(rng.random()) for _ in range(30)) for _ in range(3))
    rows = [(5, a), (3, a), (9, a), (9, a), (7, a + b), (7, b), (8, b), (2, c), (2, c + a), (4, "short"), (6, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.deduplicated(df).collect()]
    n = len(a)
    # the two texts of 2 hold c and a first; both texts of 7 keep b, as only each other has it
    want = [(5, n, n), (3, n, n), (9, n, n), (9, n, n), (7, n + len(b), n), (7, len(b), 0), (8, len(b), len(b)), (2, len(c), 0), (2, len(c) + n, 0), (4, 5, 0), (6, 5, 0)]
    assert sorted(out) == sorted(want)


def test_parts_follow_the_bytes(spark, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 1 << 10)
    monkeypatch.setattr(suffixes, "PART_SUFFIXES", 64)
    docs = spark.createDataFrame([r[:2] for r in texts], "doc_id long, text string")
    assert got(suffixes.deduplicated(docs)) == brute([r[:2] for r in texts])


def test_empty(no_docs):
    assert suffixes.deduplicated(no_docs).count() == 0


def test_null_id_is_compared_with_nothing(spark):
    t = "y" * 200
    out = suffixes.deduplicated(spark.createDataFrame([(None, t), (1, t)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in out} == {(None, 0), (1, 0)}


@pytest.mark.parametrize("segment", [128, 1 << 20])
def test_anchors_cover_every_window(monkeypatch, segment):
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    suffixes._powers.clear()
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 2000).astype(np.uint8)
    bounds = np.array([0, 30, 700, 749, 799, 1900, 2000])
    doc, at, first, last, h = suffixes.anchors(data, bounds)
    windows = {(d, s): a for d, a, f, e in zip(doc, at, first, last, strict=True) for s in range(f, e + 1)}
    assert set(windows) == {(d, s) for d in range(6) for s in range(bounds[d], bounds[d + 1] - 49)}
    assert all(s <= a <= s + suffixes.SPAN - 1 for (_, s), a in windows.items())
    by = {}
    for (_, s), a in windows.items():
        assert by.setdefault(data[s : s + 50].tobytes(), a - s) == a - s
    suffixes._powers.clear()


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, (5000, 4)).astype(np.uint64)
    order = suffixes.multikey_quicksort(words)
    assert [tuple(r) for r in words[order]] == sorted(map(tuple, words))
