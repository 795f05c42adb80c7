"""Training corpus from documents: toxicity, near duplicates, repeated passages, mixture, packed sequences.

Each stage gets all rows that the one before it kept and returns a frame that is written as Parquet and read again; all
but the last return the columns of ``documents``, whatever their names, as the operators' own begin with ``__``.

Cases: null languages and sources are values like others. Null and empty texts and texts of blanks are not toxic; they are
copies of each other, so the second stage keeps one of them all, with its row as it is; later stages keep it, and it becomes
a piece of the end id alone. Rows that share an id are rows of their own, told apart by their texts, or by all columns where
these decide; of rows with one id and one text one stays, the first by all its columns as JSON. A null id comes after all
others, so its row stays only if no copy has an id. Ties go to the least id. Texts of any length are read whole. A stage of
an empty table is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseflow.llm import mixing, nearcopies, packing, registry, suffixes, toxicity
from phaseflow.llm.scratch import alone, dropped, written
from phaseflow.session import reachable, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score at least ``registry.TOXIC``; the model sees the labels that op7 sees."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~registry.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model, docs.columns, prefix="__tox_")
    return scored.filter(F.col("__tox_score") < registry.TOXIC).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the least id of each group of near copies: texts that SimHash trees find and whose 5-word shingles
    are 0.8 alike or more. Rows are told by id and text, so that other rows with the id of a near copy stay."""
    near = nearcopies.near_copies(docs)
    first = F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("h") == F.col("lead_h"))
    gone = written(near.filter(~first).select(F.col("id").alias("__gone"), F.col("h").alias("__h")), "pipeline-gone")
    match = docs["doc_id"].eqNullSafe(gone["__gone"]) & (nearcopies.text_hash(docs["text"]) == gone["__h"])
    left = docs.join(gone.hint("shuffle_hash"), match, "left_anti")
    several = near.filter(first).groupBy(F.col("id").alias("__id"), F.col("h").alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    several = written(several.filter("__n > 1"), "pipeline-several")
    if several.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(several["__id"]) & (nearcopies.text_hash(left["text"]) == several["__h"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(several, same).groupBy("__id", "__h").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return left.join(several, same, "left_anti").union(one.select("__row.*"))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages out that a document with a smaller id has; documents stay, if need be with an empty text."""
    keep = [c for c in docs.columns if c != "text"]
    cut = suffixes.deduplicated(docs, keep=keep, text_too=True, prefix="__cut_").withColumnRenamed("__cut_kept_text", "text")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.emitted(docs, written(mixing.mix(docs).select("doc_id", mixing.ROW, "copies"), "pipeline-mix"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return packing.pack(docs, registry.tokenizer_file())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffixes", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the model nor the fingerprints nor the tokens; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(reachable(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        docs = alone(spark, lambda stage=stage, before=before: stage(spark, before, sf_dir), f"pipeline-{name}")
        if k:
            dropped(before)
    return docs
