"""The registry of saved modes as versions of one table: written beside the one in use, then named by a file that only one writer can create."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODE = (
    "index string, name string, lines array<string>, modeFolder string, selectedFactor string, selectedFactor2 string, photoOption array<string>, "
    "savedBrushTimeRanges array<struct<code:string,startDate:string,endDate:string,saveTime:bigint>>, recentNDaysValue string"
)
STRUCT = ", ".join(f.replace(" ", ":", 1) for f in MODE.split(", "))
FIELDS = tuple(f.split()[0] for f in MODE.split(", "))


class Conflict(RuntimeError):
    """Another writer has made the next version."""


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """One row for each mode of JSON files, which hold a list, one object or an object a line, with all its fields, null where it lacks one. A corrupt file gives no rows."""
    text = F.trim(F.regexp_replace("value", "^\ufeff", ""))
    whole = F.when(F.startswith(text, F.lit("[")), text).otherwise(F.concat(F.lit("["), F.regexp_replace(text, r"\}\s*\n\s*\{", "},{"), F.lit("]")))
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.from_json(whole, f"array<struct<{STRUCT}>>")))
    return rows.where("index is not null")


def complete(modes: DataFrame) -> DataFrame:
    """modes with all fields of a mode, in order; those that are missing are null."""
    kinds = dict(f.split(" ", 1) for f in MODE.split(", "))
    return modes.select(*[(F.col(f) if f in modes.columns else F.lit(None)).cast(kinds[f]).alias(f) for f in FIELDS])


def unknown(modes: DataFrame, known: DataFrame) -> DataFrame:
    """One mode for each index that `known` doesn't have: of several the least as JSON. Modes without an index or a name leave."""
    new = complete(modes).where("index is not null and name is not null").join(known.select("index"), "index", "left_anti")
    return new.groupBy("index").agg(F.min_by(F.struct(*FIELDS), F.to_json(F.struct(*FIELDS))).alias("m")).select("m.*")


class Registry:
    """Versions in a folder of any file system: `version-N` names the folder that has the modes of version N."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version's number; 0 if there is none."""
        found = self.files.globStatus(self.path(f"{self.folder}/version-*"))
        return max((int(f.getPath().getName().rpartition("-")[2]) for f in found or []), default=0)

    def modes(self, version: int | None = None) -> DataFrame:
        """The modes of a version, the newest by default; none of version 0."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MODE)
        stream = self.files.open(self.path(f"{self.folder}/version-{version:012d}"))
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        return self.spark.read.schema(MODE).parquet(f"{self.folder}/{name}")

    def save(self, modes: DataFrame, version: int) -> int:
        """Makes modes the version after `version`. Raises Conflict, and leaves the registry as it is, if there is one already."""
        name = f"modes-{uuid.uuid4().hex}"
        complete(modes).coalesce(1).write.parquet(f"{self.folder}/{name}")
        mark = self.path(f"{self.folder}/version-{version + 1:012d}")
        try:
            if self.version() != version:
                raise Conflict(f"version {version} is no longer the newest")
            out = self.files.create(mark, False)
        except (Conflict, Py4JJavaError) as e:
            self.files.delete(self.path(f"{self.folder}/{name}"), True)
            if isinstance(e, Conflict) or self.files.exists(mark):
                raise Conflict(f"version {version + 1} exists") from e
            raise
        out.write(bytearray(name.encode()))
        out.close()
        return version + 1

    def change(self, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Saves what `change` makes of the newest modes; where another writer comes first, it is made anew of theirs."""
        for _ in range(tries):
            version = self.version()
            try:
                return self.save(change(self.modes(version)), version)
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers came first")

    def insert(self, new: DataFrame) -> int:
        """Adds the new modes whose index the registry doesn't have."""
        return self.change(lambda known: known.unionByName(unknown(new, known)))
