"""Toxicity by multiple-instance learning.

A text is a bag of sentences; only texts have labels. A sentence's score is logistic in the words it holds and their
beginnings, the scores are combined by noisy-or (a text is toxic unless none of its sentences is), and the weights are
fitted to the labels of texts through that combination, so sentences are learned without labels of their own and the
offending ones can be shown. Weights are sparse: what does not help to tell labels has none. A sentence without any
weight scores 0, so a long clean text does not gather a score from its many sentences.

The model is fitted on the driver to a sample of at most ``SAMPLE`` labelled texts of at most ``SAMPLE_CHARS``
characters together, the first by a hash of their id but with up to ``OF_EACH`` of each label; a text that does not fit
is left out and others go on, and texts of more than ``LONG`` characters come last. Scoring covers every text whole and needs words only.

Cases: a null or empty text scores 0; texts without a label are scored like others; without labelled toxic texts all
scores are 0; of several labels of one text the greatest counts; repeated rows are scored alike; extra columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phaseflow.llm import worker
from phaseflow.llm.scratch import written

SAMPLE, SAMPLE_CHARS = 8_000, 40_000_000
#: Rows of each label that the sample has first, if there are as many; texts of more characters come last of all.
OF_EACH, LONG = 1_000, 50_000
#: A feature is a word or one of its beginnings of these lengths; it takes part if at least LEAST_TEXTS toxic sample
#: texts have it and toxic texts have it LIFT times as often as others.
BEGINNINGS = (3, 4, 5, 6, 7)
LEAST_TEXTS, LIFT = 3, 4.0
STEPS, RATE, L1, START = 300, 0.5, 0.1, -3.0
#: Words of which a worker remembers the weight.
CACHE = 250_000

_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches between sentence ends that hold a word."""
    out, begin = [], 0
    for m in _SENTENCE.finditer(text):
        if _WORD.search(text, begin, m.start()):
            out.append((begin, m.start()))
        begin = m.end()
    if _WORD.search(text, begin):
        out.append((begin, len(text)))
    return out


def features(word: str) -> list[str]:
    """The word, marked as whole, and its proper beginnings."""
    return [word + "$", *[word[:k] for k in BEGINNINGS if k <= len(word)]]


class Model:
    """Weights of features and the bias of a sentence."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.of_word: dict[str, float] = {}

    def weight(self, word: str) -> float:
        if len(self.of_word) > CACHE:
            self.of_word.clear()
        get = self.weights.get
        w = self.of_word[word] = sum(get(f, 0.0) for f in features(word))
        return w

    def probability(self, words: set[str]) -> float:
        """Score of a sentence with these words in lower case; 0 if no feature of them has a weight."""
        known, total = self.of_word.get, 0.0
        for w in words:
            x = known(w)
            total += self.weight(w) if x is None else x
        return _sigmoid(self.bias + total) if total else 0.0

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and (start, end, score) of its sentences."""
        spans = [(a, b, self.probability(set(_WORD.findall(text[a:b].lower())))) for a, b in sentences(text)]
        clean = sum(math.log1p(-min(p, 1 - 1e-12)) for _, _, p in spans)
        return abs(math.expm1(clean)), spans


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _vocabulary(texts: Sequence[str], labels: np.ndarray) -> dict[str, int]:
    sets = lambda label: ({f for w in set(_WORD.findall(t.lower())) for f in features(w)} for t, y in zip(texts, labels, strict=True) if y == label)
    toxic = Counter(f for s in sets(1) for f in s)
    toxic = {f: n for f, n in toxic.items() if n >= LEAST_TEXTS}
    other = Counter(f for s in sets(0) for f in s if f in toxic)
    scale = max(1, int((labels == 0).sum())) / max(1, int((labels == 1).sum()))
    return {f: i for i, f in enumerate(sorted(f for f, n in toxic.items() if n * scale >= LIFT * other[f]))}


def fit(texts: Sequence[str], labels: Sequence[int]) -> Model:
    """Noisy-or likelihood under an L1 penalty, by proximal gradient steps with per-weight rates."""
    y = np.asarray(labels, float)
    vocabulary = _vocabulary(texts, y)
    if not vocabulary:
        return Model(START, {})
    columns: list[int] = []
    ends: list[int] = []
    owner: list[int] = []
    for k, t in enumerate(texts):
        for a, b in sentences(t):
            found = {f for w in set(_WORD.findall(t[a:b].lower())) for f in features(w)}
            own = sorted(vocabulary[f] for f in found if f in vocabulary)  # sets of text have another order in each process
            if own:  # sentences without features score 0
                columns.extend(own)
                ends.append(len(columns))
                owner.append(k)
    col, doc = np.array(columns, np.int32), np.array(owner)
    size = np.diff(np.array([0, *ends]))
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    w, b = np.zeros(len(vocabulary)), START
    seen_w, seen_b = np.full(len(vocabulary), 1e-8), 1e-8
    for _ in range(STEPS):
        z = b + np.bincount(row, w[col], len(size))
        p = np.clip(1 / (1 + np.exp(-z)), 1e-12, 1 - 1e-12)
        clean = np.exp(np.bincount(doc, np.log1p(-p), len(y)))
        bag = np.maximum(1 - clean, 1e-12)
        g = p * (y * (1 - bag) / bag - (1 - y))[doc]
        up = np.bincount(col, g[row], len(w))
        seen_w += up**2
        seen_b += g.sum() ** 2
        rate = RATE / np.sqrt(seen_w)
        w = w + rate * up
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        b += RATE / math.sqrt(seen_b) * g.sum()
    return Model(float(b), {x: float(w[i]) for x, i in vocabulary.items() if w[i]})


def _first(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column) -> tuple[list[str], list[int]]:
    """Texts and labels of the sample, by a hash of the id: at most ``SAMPLE`` rows, the first ``OF_EACH`` of each label
    among them, and of these all that fit in ``SAMPLE_CHARS`` characters."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    marked = written(marked.filter(learn).withColumn("__h", F.xxhash64(id_col)), "toxicity-marked")
    order, any_label = ["__h", id_col], marked.withColumn("__late", F.lit(1))
    drawn = any_label.orderBy(*order).limit(SAMPLE)
    for toxic in (F.col("__y") == 1, F.col("__y") != 1):
        drawn = drawn.union(marked.filter(toxic).withColumn("__late", F.lit(0)).orderBy(*order).limit(min(OF_EACH, SAMPLE // 2)))
    marked = drawn.groupBy(id_col, "__y", "__h").agg(F.min("__late").alias("__late")).orderBy("__late", *order).limit(SAMPLE)
    marked = written(marked, "toxicity-sample")
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(marked), id_col)  # at most SAMPLE rows
    texts = texts.groupBy(id_col, "__h", "__y", "__late").agg(F.min("__text").alias("__text"))
    texts = written(texts.withColumn("__n", F.length("__text")), "toxicity-texts")
    sizes = texts.select(id_col, "__n", (F.col("__n") > LONG).alias("__long")).orderBy("__long", texts["__late"], *order).collect()  # at most SAMPLE rows
    taken, left = [], SAMPLE_CHARS
    for r in sizes:
        if r["__n"] <= left:
            taken.append((r[id_col],))
            left -= r["__n"]
    taken = docs.sparkSession.createDataFrame(taken, docs.select(id_col).schema)
    rows = texts.join(F.broadcast(taken), id_col).orderBy(*order).select("__text", "__y").toLocalIterator()
    pairs = [(r[0], r[1]) for r in rows]
    return [t for t, _ in pairs], [y for _, y in pairs]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", learn: Column | None = None) -> Model:
    """Model fitted to the labelled rows for which ``learn`` (a condition on the id) holds."""
    return fit(*_first(docs, labels, id_col, text_col, label_col, F.lit(True) if learn is None else learn))


SENTENCE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def _scored(model: Model, at: int, names: list[str], keep_text: bool, show: float | None):
    """Rows to the kept columns and the results, named ``names``; the text is column ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("toxicity")
        for batch in batches:
            judged = [model.judge(t or "") for t in batch.column(at).to_pylist()]
            cols = [c for k, c in enumerate(batch.columns) if k != at or keep_text]
            cols.append(pa.array([s for s, _ in judged], pa.float64()))
            if show is not None:
                found = [[{"start": a, "end": b, "score": p} for a, b, p in spans if p >= show] for _, spans in judged]
                cols.append(pa.array(found, pa.list_(SENTENCE)))
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def score(docs: DataFrame, model: Model, keep: Sequence[str], text_col: str = "text", show: float | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` and ``score``; with ``show`` also ``offending``: the sentences that score at least that much.

    A sentence is (start, end, score), in characters of the text. ``text_col`` may be in ``keep`` too. The names of the
    results begin with ``prefix``; kept columns of these names give way to them.
    """
    sentence = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
    results = [T.StructField(f"{prefix}score", T.DoubleType())]
    results += [T.StructField(f"{prefix}offending", T.ArrayType(sentence))] if show is not None else []
    keep = [c for c in keep if c not in {f.name for f in results}]
    kept = text_col in keep
    rows = docs.select(*keep) if kept else docs.select(*keep, F.col(text_col).alias("__text"))
    at = rows.columns.index(text_col if kept else "__text")
    schema = T.StructType([*(f for k, f in enumerate(rows.schema.fields) if kept or k != at), *results])
    return rows.mapInArrow(_scored(model, at, schema.names, kept, show), schema)
