"""Small Spark helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.store import cut, share  # noqa: F401


def ids(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the two columns in use, under fixed names, so that other columns can't clash. Rows without an id are not documents and leave."""
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where("doc_id is not null")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a small file, by whatever file system its path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()


def tidy() -> None:
    """Gives memory that this worker has freed back to the machine; workers live on between stages. Where the C library has no call for it, Arrow's share alone goes back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(f: Callable) -> Callable:
    """f, followed by tidy()."""

    @functools.wraps(f)
    def call(*args):
        out = f(*args)
        tidy()
        return out

    return call
