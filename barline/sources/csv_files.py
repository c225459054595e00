"""CSV files of mixed layouts: each is read once, by the task that parses it, by its own header."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARK = b"\xef\xbb\xbf"


def _header(content: bytes) -> list[str]:
    """Column names of the first line that isn't empty; of names that repeat the first stays, the others are empty."""
    line = content.lstrip(b"\r\n").split(b"\n", 1)[0].decode("utf-8", "replace")
    names = [x.strip() for x in next(csv.reader([line.rstrip("\r")]), [])]
    return [x if x not in names[:i] else "" for i, x in enumerate(names)]


def parse(content: bytes, wanted: list[str], needed: str) -> pa.Table:
    """The wanted columns of a CSV file as text, by its header; null where the file has no such column or an empty cell.

    A file whose header lacks the needed column has no rows. Rows with cells too few or too many are cut or filled up, and then lines are read one by one.
    """
    content = content.removeprefix(_MARK)
    names = _header(content)
    if needed not in names:
        return pa.table({x: pa.array([], pa.string()) for x in wanted})
    try:
        labels = [x or f" {i}" for i, x in enumerate(names)]  # no wanted column begins with a blank
        found = pc.read_csv(
            io.BytesIO(content.lstrip(b"\r\n")),
            read_options=pc.ReadOptions(column_names=labels, skip_rows=1, use_threads=False),
            parse_options=pc.ParseOptions(newlines_in_values=False),
            convert_options=pc.ConvertOptions(column_types=dict.fromkeys(labels, pa.string()), include_columns=[x for x in wanted if x in names], null_values=[""], strings_can_be_null=True),
        )
        have = {x: found[x] for x in found.column_names}
        size = found.num_rows
    except pa.ArrowInvalid:
        lines = csv.reader(io.StringIO(content.decode("utf-8", "replace")))
        rows = [r for r in lines if r][1:]
        at = {x: names.index(x) for x in wanted if x in names}
        have = {x: pa.array([r[i] if i < len(r) and r[i] != "" else None for r in rows], pa.string()) for x, i in at.items()}
        size = len(rows)
    return pa.table({x: have.get(x, pa.nulls(size, pa.string())) for x in wanted})


def read(spark: SparkSession, path: str, wanted: list[str], needed: str) -> DataFrame:
    """file (its name) and the wanted columns as text of all CSV files under a path.

    Spark reads the bytes, from whatever store, and packs small files into one task; a file is parsed whole, so it may have 2 GB at most.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("file", *wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["file"].to_pylist(), batch["content"], strict=True):
                found = parse(content.as_buffer().to_pybytes(), wanted, needed)
                for part in found.to_batches(max_chunksize=1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.num_rows, pa.string()), *part.columns], names=schema.names)

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)
