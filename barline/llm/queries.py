"""The registered query of each operator: production parameters, whole tables, and the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import alignment, collocations, dropout_bpe, lsh_forest, maxscore, packing, quality, rlz, rules, sharding, suffix_array, toxicity, webp
from barline.llm._sample import fold
from barline.llm._spark import table
from barline.llm.oracle import ORACLE_SQL  # noqa: F401


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rlz.dedup_words(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def _scored(score: Callable, spark: SparkSession, sf_dir: str, folds: int, held: int) -> DataFrame:
    out = fold("doc_id", folds) == held
    scores = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~out)
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(toxicity.score, spark, sf_dir, 4, 2)


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.text_media(table(spark, sf_dir, "documents"))


def op5_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lsh_forest.components(table(spark, sf_dir, "documents"), shingle=3, similarity=(85, 100))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op6_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropout_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(quality.score, spark, sf_dir, 5, 0)


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = maxscore.quantised(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(rows.where("vec_id % 50 = 0"), rows)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.dedup_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = rules.cascade(table(spark, sf_dir, "documents"), report=("n_words", *base))
    return found.select("doc_id", "n_words", *base, F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words").alias("base_failed"), "kept")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_rlz_dedup, op2_packing, op3_toxicity, op4_webp, op5_lsh_forest, op6_jump_sharding, op7_merge_dropout, op8_quality, op9_maxscore, op10_suffix_dedup, op11_rule_cascade, op12_collocations, op13_alignment)}
