from __future__ import annotations

import random

import numpy as np

from phaseflow.llm import toxicity

BAD = ["vile", "scum", "idiot"]


def corpus(n: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(["river", "stone", "walks", "green", "house", "quiet", "table"]) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        toxic = i % 5 == 0
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] += f" {rng.choice(BAD)} {rng.choice(BAD)}s"
        out.append((i, ". ".join(sentences) + ".", int(toxic)))
    return out


def test_learns_and_locates(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, "keep") for i, t, _ in rows], "doc_id long, text string, extra string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, learn=toxicity.F.col("doc_id") < 600)
    got = toxicity.score(docs, model, ["doc_id", "text"], show=0.5).collect()
    held = [(r.score, rows[r.doc_id][2], r) for r in got if r.doc_id >= 600]
    assert all((s >= 0.7) == bool(y) for s, y, _ in held)
    for _, y, r in held:
        shown = [r.text[x.start : x.end] for x in r.offending]
        assert bool(shown) == bool(y) and all(any(b in s for b in BAD) for s in shown)


def test_noisy_or():
    model = toxicity.Model(-3.0, {"bad$": 4.0, "ver": -1.0})
    score, spans = model.judge("All fine. This is bad! Very bad bad.\n\n ...")
    assert [s for _, _, s in spans] == [0.0, toxicity._sigmoid(1.0), toxicity._sigmoid(0.0)]
    assert np.isclose(score, 1 - np.prod([1 - s for _, _, s in spans]))
    assert model.judge("")[0] == model.judge("Fine. " * 100_000)[0] == 0


def test_one_sentence_of_a_very_long_text(spark):
    model = toxicity.Model(-4.0, {"vile$": 8.0})
    text = "Some fine words here. " * 200_000 + "So vile a thing! " + "More of them. " * 1000
    df = spark.createDataFrame([(1, text), (2, text.replace("vile", "fine"))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(df, model, ["doc_id"], show=0.5).collect()}
    assert got[1].score > 0.9 and [text[x.start : x.end].strip() for x in got[1].offending] == ["So vile a thing"]
    assert got[2].score == 0 and not got[2].offending


def test_the_same_sample_whatever_the_order(spark, monkeypatch):
    """Texts at the bound are chosen by hash and id, and copies of a row count once."""
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    rows = [(i, f"text {i}", i % 2) for i in range(100)] * 2
    drawn = []
    for n in (1, 7):
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(n)
        labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").repartition(n)
        drawn.append(toxicity._first(docs, labels, "doc_id", "text", "toxic", toxicity.F.lit(True)))
    assert drawn[0] == drawn[1] and len(drawn[0][0]) == len(set(drawn[0][0])) == 20


def test_odd_rows(spark, docs, texts, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    got = toxicity.score(docs.drop("score"), model, ["doc_id", "lang"]).collect()
    assert len(got) == len(texts) and all(r.score == 0 for r in got)
    assert toxicity.score(no_docs.drop("score"), toxicity.train(no_docs, none), ["doc_id"]).count() == 0


def test_sample_has_rare_labels_and_goes_on_after_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 60)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 60_000)
    rows = [(i, ("vile scum. " if i % 100 == 0 else "green river. ") * 3, int(i % 100 == 0)) for i in range(1000)]
    first = spark.range(1000).orderBy(toxicity.F.xxhash64("id")).first().id
    rows[first] = (first, "river " * 20_000, rows[first][2])
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts, y = toxicity._first(docs, labels, "doc_id", "text", "toxic", toxicity.F.lit(True))
    assert len(texts) == 59 and sum(y) == 10 - rows[first][2]
    model = toxicity.train(docs, labels)
    assert model.judge("vile scum.")[0] > 0.5 > model.judge("green river.")[0]
