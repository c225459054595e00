"""Regular bars from raw tables, and readers and writers of bar files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.ma import by_time
from barline.functions.scalars import parse_date, stock_code
from barline.operators import blocks
from barline.sources import csv_files, registry

_OWN = tuple(f for f in registry.FIELDS if f != "savedBrushTimeRanges")  # a mode's fields beside its ranges
BASE = 10_000_000  # cents; a walk starts here, high enough to stay positive
BARS = T.StructType([T.StructField(c, t) for c, t in (("code", T.StringType()), ("timestamps", T.StringType()), *((c, T.DoubleType()) for c in ("open", "close", "high", "low", "vol")), *((c, T.StringType()) for c in ("name", "industry", "block")))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: code (its part's brand), ts (day), cents (unit price), qty, and the keys that order a day."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("code"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").alias("ts"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("qty"))
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bars in cents: code, ts, open, close, high, low, mean (rounded down), vol."""
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")
    return trades(spark, sf_dir).groupBy("code", "ts").agg(F.min_by("cents", place).alias("open"), F.max_by("cents", place).alias("close"), F.max("cents").alias("high"), F.min("cents").alias("low"), F.expr("sum(cents) div count(*)").alias("mean"), F.sum("qty").alias("vol"))


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is a random walk: BASE plus the running sum of each day's mean less the overall mean. code, ts, open, high, low, close, vol.

    A day's open, high and low lie as far from its close as they lie from its mean price. Nothing runs before the query does; the overall
    mean is a second scan, of the columns that make a price.
    """
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents")
    lines = trades(spark, sf_dir)
    days = lines.groupBy("code", "ts").agg(
        F.min_by("cents", place).alias("first"), F.max("cents").alias("most"), F.min("cents").alias("least"),
        F.expr("sum(cents) div count(*)").alias("mean"), F.sum("qty").alias("vol"),
    )
    # One row: the broadcast has a fixed size.
    overall = lines.agg(F.expr("sum(cents) div count(*)").alias("overall"))
    close = (F.lit(BASE) + F.sum(F.col("mean") - F.col("overall")).over(by_time())).cast("long")
    rows = days.crossJoin(F.broadcast(overall)).withColumn("close", close)
    beside = lambda c: (F.col("close") + F.col(c) - F.col("mean")).alias({"first": "open", "most": "high", "least": "low"}[c])
    return rows.select("code", "ts", beside("first"), beside("most"), beside("least"), "close", "vol")


def ticks(spark: SparkSession, sf_dir: str, block: int = blocks.BLOCK) -> DataFrame:
    """A bar for every event, numbered and in blocks: code (its type), ts, event_id, close, n, block. Closes walk from BASE by each value in cents less the overall mean."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), "ts", "event_id", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"))
    overall = rows.agg(F.expr("sum(cents) div count(*)").alias("overall"))  # one row
    steps = rows.crossJoin(F.broadcast(overall)).where("code is not null and cents is not null")
    found = blocks.numbered(steps, {"total": F.col("cents") - F.col("overall")}, ("ts", "event_id"), block)
    return found.select("code", "ts", "event_id", (F.lit(BASE) + F.col("total")).cast("long").alias("close"), "n", "block")


def index_series(bars: DataFrame) -> DataFrame:
    """One series over all codes: ts and the mean close of the day, rounded down."""
    return bars.groupBy("ts").agg(F.expr("sum(close) div count(*)").alias("close"), F.sum("vol").alias("vol"))


def read_csv_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, pool: DataFrame | None = None, extra: tuple[str, ...] = (), with_file: bool = False) -> DataFrame:
    """Bars of CSV files: code, ts, open, close, high, low, vol, name, industry, block, and the numeric columns in `extra`, such as stored averages.

    Columns are found by their names in each file's own header, in any order; those that a file lacks are null, others are not read.
    Each file is read once, and no list of names is gathered; with_file keeps its name as `file`. Without a code, it is the six digits in the file's name. Rows without a date or close leave; so do rows outside the range
    (both ends included) and outside the pool. Files need a header with `timestamps`; a byte order mark is ignored.
    """
    wanted = {f.name: f.dataType for f in BARS} | dict.fromkeys(extra, T.DoubleType())
    found = csv_files.read(spark, path, list(wanted), "timestamps")
    by_name = F.regexp_extract("file", r"(\d{6})", 1)
    code = F.coalesce("code", F.when(by_name != "", by_name))
    rows = found.select(*(["file"] if with_file else []), *[(code if c == "code" else F.col(c).try_cast(t)).alias(c) for c, t in wanted.items()])
    rows = rows.withColumns({"code": stock_code(F.col("code")), "ts": parse_date(F.col("timestamps"))}).where("ts is not null and close is not null")
    if start is not None:
        rows = rows.where(F.col("ts") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("ts") <= F.lit(end).cast("date"))
    if pool is not None:
        rows = rows.join(pool.select(stock_code(F.col("code")).alias("code")).distinct(), "code", "left_semi")
    return rows.drop("timestamps")


def read_feature_names(spark: SparkSession, path: str) -> list[str]:
    """The names of a model's feature list, in the file's order; a list is one small file."""
    return [r["feature"] for r in spark.read.csv(path, header=True, schema="feature string").where("feature is not null").collect()]


def covering_files(bars: DataFrame, ranges: DataFrame, prefer: tuple[str, ...] = (), only: bool = False) -> DataFrame:
    """(code, start, end) and the source whose bars of the same code cover the range: the first in `prefer` that does, else the first by name; with `only`, none but those in `prefer`. bars have code, ts and file."""
    spans = bars.groupBy("code", "file").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    hit = ranges.join(spans, "code").where("first <= start and last >= end")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, prefer)), F.col("file")), F.lit(0)), F.lit(len(prefer) + 1)) if prefer else F.lit(1)
    hit = hit.withColumn("_place", place)
    hit = hit.where(F.col("_place") <= len(prefer)) if only else hit
    return hit.groupBy("code", "start", "end").agg(F.min(F.struct("_place", "file")).alias("m")).select("code", "start", "end", "m.file")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Codes of a text file, one on a line; lines that begin with # are comments."""
    return spark.read.text(path).select(F.trim("value").alias("code")).where("code <> '' and not startswith(code, '#')").select(stock_code(F.col("code")).alias("code")).distinct()


def read_index_json(spark: SparkSession, path: str) -> DataFrame:
    """An index series of positional JSON rows: day, low, high, close, open, vol."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    fields = ("low", "high", "close", "open", "vol")
    return rows.select(parse_date(F.get("r", 0)).alias("ts"), *[F.get("r", i + 1).try_cast("double").alias(c) for i, c in enumerate(fields)])


INDEXES = ("000001", "399001")


def read_index(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """The series of one of the two known indexes, from the file of its name in a folder; any other index has no rows."""
    if index not in INDEXES:
        return spark.createDataFrame([], "ts date, low double, high double, close double, open double, vol double")
    return read_index_json(spark, f"{folder}/{index}.json")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Saved modes with all their fields: one row for each saved range, and one with nulls for a mode without any. A corrupt file gives no rows."""
    rows = registry.read_modes(spark, path).withColumn("range", F.explode_outer("savedBrushTimeRanges"))
    return rows.select(*_OWN, "range.*")


def add_modes(known: DataFrame, new: DataFrame) -> DataFrame:
    """The registry's rows with the new modes whose index it doesn't have; of new modes with one index, one. Versions of a registry: see registry.py."""
    ranges = ("code", "startDate", "endDate", "saveTime")
    both = new.select(*new.columns, *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns if c not in new.columns])
    one = both.join(known, "index", "left_anti").withColumn("_key", F.to_json(F.struct(*[c for c in known.columns if c not in ranges])))
    first = one.groupBy("index").agg(F.min("_key").alias("_key"))
    return known.unionByName(one.join(first, ["index", "_key"], "left_semi").select(*known.columns))


def write_fragments(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("code", "fragment_id").parquet(path)


def write_summary(segments: DataFrame, path: str) -> None:
    """Segments as CSV, their feature vectors as comma-separated text."""
    flat = segments.withColumn("feature_vector", F.array_join(F.transform("feature_vector", lambda x: x.cast("string")), ","))
    flat.write.mode("overwrite").csv(path, header=True)


def write_registry(modes: DataFrame, path: str) -> None:
    """Replaces the registry: one JSON object for each mode with all its fields, its saved ranges in a list."""
    saved = F.filter(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "startDate", "endDate", "saveTime"))), lambda r: r.isNotNull())
    rows = modes.groupBy("index").agg(*[F.first(c, ignorenulls=True).alias(c) for c in _OWN[1:] if c in modes.columns], saved.alias("savedBrushTimeRanges"))
    rows.write.mode("overwrite").json(path)


def as_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Each row, with all that is nested in it, as one JSON text; columns without a value are left out."""
    return rows.select(F.to_json(F.struct("*")).alias(column))


def flattened(results: DataFrame, column: str = "items") -> DataFrame:
    """A row for each element of an array of structs, beside the other columns; rows with an empty list leave."""
    return results.select(*[c for c in results.columns if c != column], F.inline(column))


def renamed(bars: DataFrame, names: dict[str, str], **literals: object) -> DataFrame:
    """The named columns in the mapping's order under their new names, with literal columns behind them."""
    return bars.select(*[F.col(a).alias(b) for a, b in names.items()], *[F.lit(v).alias(c) for c, v in literals.items()])
