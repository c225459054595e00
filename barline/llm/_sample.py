"""Bounded samples of labelled documents, and models fitted on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm._spark import tidy


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def labelled(documents: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, chars: int) -> DataFrame:
    """doc_id, text and _label (0 or 1) of the `rows` learnable rows whose ids hash lowest, without those of more than `chars` characters.

    The two bounds keep what reaches the fitting task below rows * chars characters at any size of the corpus. Ids are chosen before
    any text is moved, so the broadcast holds `rows` ids at most. Of rows that share an id the least text counts.
    """
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label")).where(learn)
    chosen = marks.join(documents.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("_label").cast("long").alias("_label"))


def fitted(sample: DataFrame, fit: Callable[[list[str], np.ndarray], Any]) -> Any:
    """fit(texts, labels) of the rows of `labelled`, by id, in one task; the driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held).sort_by("doc_id")
            model = fit(rows["text"].to_pylist(), rows["_label"].to_numpy())
            del held, rows
        else:
            model = fit([], np.zeros(0, np.int64))
        tidy()  # workers live on
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit([], np.zeros(0, np.int64))


def kept(documents: DataFrame, text_column: str, id_column: str, scores: Callable[[pa.Array], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text's score is one to keep: every row by its own text, in the task that reads it, so nothing is exchanged. Rows without an id leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(scores(batch[text_column])), pa.bool_()))
        tidy()

    return documents.where(F.col(id_column).isNotNull()).mapInArrow(run, documents.schema)
