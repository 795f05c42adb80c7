"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phaseflow.llm import caps, licenses, mixing, oracles, packing, quality, simhash, suffixes, tokens, toxicity, urls
from phaseflow.llm.scratch import written
from phaseflow.session import table


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op2_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = caps.near_duplicates(table(spark, sf_dir, "embeddings"))
    return near.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def tokenizer_file() -> str:
    """The public tokenizer's file, at the same place on each machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", F.round("d2", 4).alias("d2"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


RULES = (
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judged(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the model never sees."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


TOXIC = 0.7


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~held_out(F.col("doc_id")))
    scored = written(toxicity.score(docs, model, ["doc_id"]), "toxicity-scores")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_documents(*tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_file()))


QUERIES = {f.__name__: f for f in (op1_suffixes, op2_caps, op3_packing, op4_mixing, op5_simhash, op6_urls, op7_toxicity, op8_tokens, op9_licenses, op10_quality)}
ORACLES = oracles.SQL
