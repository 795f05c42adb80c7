from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest

from phaseflow.llm import mixing, registry, scratch, toxicity
from phaseflow.llm.scratch import written
from phaseflow.session import table
from tests.llm import test_nearcopies as plain_near
from tests.llm import test_suffixes as plain_suffixes
from tests.llm.test_tokens_and_packing import ids

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    docs = table(spark, DATA, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), f"test-{name}")
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_names_and_columns(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffixes", "mixing", "packing"]
    assert all(df.columns == staged[0].columns and df.dtypes == staged[0].dtypes for df in staged[1:-1])


def test_toxicity(spark, staged):
    model = toxicity.train(staged[0], table(spark, DATA, "labels"), learn=~registry.held_out(toxicity.F.col("doc_id")))
    assert set(by_id(staged[1])) == {i for i, t in by_id(staged[0]).items() if model.judge(t)[0] < registry.TOXIC}


def test_simhash(staged):
    """One document of each group whose 5-word shingles are 0.8 alike, the one with the least id."""
    before = sorted(by_id(staged[1]).items())
    lead = plain_near.brute([t for _, t in before])
    assert by_id(staged[2]) == {before[k][0]: before[k][1] for k in set(lead)}


def test_suffixes(staged):
    before, after = by_id(staged[2]), by_id(staged[3])
    want = plain_suffixes.brute(list(before.items()))
    assert set(after) == set(before)
    for i, t in after.items():
        size, removed, _, digest = want[i]
        if not removed:
            assert t == before[i]
        assert len(t.encode()) <= size - removed
        assert t.isascii() is False or plain_suffixes.hashlib.sha256(t.encode()).hexdigest() == digest
    assert all(r.n_chars == len(r.text) for r in staged[3].collect())


def test_mixing(staged):
    copies = {r.doc_id: r.copies for r in mixing.mix(staged[3]).collect()}
    assert Counter(r.doc_id for r in staged[4].collect()) == Counter({i: n for i, n in copies.items() if n})


def test_packing(staged):
    texts, times = by_id(staged[4]), Counter(r.doc_id for r in staged[4].collect())
    rows = staged[5].collect()
    done = Counter()
    for r in rows:
        x = ids(texts[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
        done[r.doc_id] += r.length
    assert done == {i: n * len(ids(texts[i])) for i, n in times.items()}


def test_run_leaves_its_result_only(spark, staged, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda spark: str(tmp_path))
    out = corpus_pipeline.run(spark, DATA)
    assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["pipeline-packing"]
    assert sorted(out.drop("sequence_id", "offset").collect()) == sorted(staged[5].drop("sequence_id", "offset").collect())


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    long = spark.range(0, 32, 1, 1).select(toxicity.F.repeat(toxicity.F.lit("x"), 1 << 20).alias("t"))
    before = [spark.conf.get(k, None) for k in (scratch.BATCH, scratch.BATCH_BYTES[0], scratch.CLEANUP)]
    out = written(long.mapInArrow(sizes, "n long"), "sizes").collect()
    assert sum(r.n for r in out) == 32 and max(r.n for r in out) <= 8
    assert [spark.conf.get(k, None) for k in (scratch.BATCH, scratch.BATCH_BYTES[0], scratch.CLEANUP)] == before


def test_no_folder_of_its_own_on_a_cluster(spark):
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_folder(Unset)


def test_own_folder_where_none_is_named(spark):
    class Unset:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        sparkContext = spark.sparkContext  # noqa: N815

    folder = scratch.shared_folder(Unset)
    assert Path(folder).is_dir() and scratch.shared_folder(Unset) == folder


def test_rows_that_share_an_id_or_all_but_one_column(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a, "en", "y"), (1, a, "en", "x"), (1, a, None, "z"), (1, b, "en", "x"), (2, b, "en", "x"), (None, None, "en", "x"), (5, "", "en", "x"), (4, " \n", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in corpus_pipeline.simhash_stage(spark, df, "").collect())
    assert got == [(1, a, "en", "x"), (1, b, "en", "x"), (4, " \n", "de", None)]


def test_repeated_rows_are_mixed_as_often_as_the_mixture_says(spark):
    long, short = " ".join(["word"] * 40), "some few words"
    rows = [(1, long, "s"), (1, short, "s"), (2, long, "s"), (2, long, "s"), (2, long, "s"), (None, short, "s"), (3, None, "t")] + [(k, long, "t") for k in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    text = {(r[0], len((r[1] or "").split())): r[1] for r in rows}
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id, text[r.doc_id, r.size], r.source] += r.copies
    out = corpus_pipeline.mixing_stage(spark, df, "")
    assert out.columns == df.columns and Counter(tuple(r) for r in out.collect()) == +want


def odd_stage_rows(spark, docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars", "copies", "score", "id", "hashes")


def test_odd_rows_and_no_rows(spark, docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (docs, no_docs):
        rows = odd_stage_rows(spark, df)
        for name, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, str(tmp_path)), f"odd-{name}")
            if name != "packing":
                assert rows.columns == df.columns
        assert (rows.count() > 0) == (df is docs)
