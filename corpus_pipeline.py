"""The corpus pipeline: quality, toxicity, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's rows as Parquet to the shared folder and reads them back, so a
stage never recomputes its predecessors and lost executors cost no more than their tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import lsh_forest, packing, quality, suffix_array, toxicity
from barline.llm._spark import share, table
from barline.sources.store import remove

#: Documents leave below this probability of good quality, and from this probability of being toxic.
QUALITY, TOXIC = 0.3, 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is QUALITY at least, each row by its own text. Null texts score as empty ones; rows without an id leave."""
    return quality.keep(docs, table(spark, sf_dir, "labels"), F.lit(True), QUALITY)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose score is below TOXIC, each row by its own text. Null texts score as empty ones; rows without an id leave."""
    return toxicity.keep(docs, table(spark, sf_dir, "labels"), F.lit(True), TOXIC)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates on five-word shingles at 0.8."""
    kept = lsh_forest.components(docs, shingle=5, similarity=(80, 100)).where("doc_id = component_id")
    return docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated stretches of 100 bytes out of the texts; n_chars follows. Documents of which nothing is left leave; those that were empty before stay."""
    out = suffix_array.dedup_texts(docs.withColumn("_empty", F.col("text") == ""))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.where("text is null or text <> '' or _empty").drop("_empty")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as token pieces in sequences of 1024: null texts count as empty, rows without an id leave, an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality classifier", good_quality), ("toxicity", not_toxic), ("near-duplicates", one_of_each_group), ("suffix-array dedup", without_repeats), ("packing", packed)]

#: The stages train models and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages together leave of the table of documents; each stage's rows lie as Parquet in a new folder of the shared one, until the next stage's are written."""
    share(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
