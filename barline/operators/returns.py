"""Forward returns, and values of an index as of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def forward_returns(segments: DataFrame, sums: DataFrame, days: int = 5) -> DataFrame:
    """Of each (code, lo, hi): n_future, mean_return, max_drawdown, max_rise, max_fall and win_rate over the next bars, in percent.

    The first bar after the segment is the price of entry; returns count from the second. Without them all are 0.
    """
    wanted = segments.select("code", "lo", "hi", F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + days)).alias("m"))
    future = wanted.join(sums.select("code", F.col("n").alias("m"), "close"), ["code", "m"])
    held = future.groupBy("code", "lo", "hi").agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "close"))), lambda x: x["close"].cast("double")).alias("p"))
    rows = segments.select("code", "lo", "hi").join(held, ["code", "lo", "hi"], "left").withColumn("p", F.coalesce("p", F.array().cast("array<double>")))
    entry = F.get("p", 0)
    rows = rows.withColumns({"r": F.transform(F.slice("p", 2, days), lambda x: (x - entry) / entry * 100), "top": F.coalesce(F.array_position("p", F.array_max("p")), F.lit(0)).cast("int")})
    lowest = F.array_min(F.slice("p", F.greatest(F.col("top"), F.lit(1)), days))
    some = F.size("r") > 0
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    zero = lambda c: F.round(F.coalesce(F.when(some, c), F.lit(0.0)), 6)
    rising = F.size(F.filter("r", lambda x: x > 0)) * 100.0 / F.nullif(F.size("r"), F.lit(0))
    fall = F.coalesce((F.array_max("p") - lowest) / F.array_max("p") * 100, F.lit(0.0))
    return rows.select(
        "code", "lo", "hi", F.size("p").alias("n_future"), zero(total / F.nullif(F.size("r"), F.lit(0))).alias("mean_return"), F.round(fall, 6).alias("max_drawdown"),
        zero(F.array_max("r")).alias("max_rise"), zero(F.array_min("r")).alias("max_fall"), zero(rising).alias("win_rate"),
    )


def as_of(points: DataFrame, series: DataFrame, columns: list[str]) -> DataFrame:
    """Each point (ts) with the series' latest values at or before it; 0 where there are none.

    The series is one row a day, so both sides are dealt into blocks of a year: a block's points look into their own block, and the last
    values of the blocks before are carried over; no task holds the whole series.
    """
    block = F.year("ts")
    side = points.select("ts").distinct().withColumns({"kind": F.lit(1), **{c: F.lit(None).cast(series.schema[c].dataType) for c in columns}})
    rows = series.select("ts", F.lit(0).alias("kind"), *columns).unionByName(side).withColumn("block", block)
    w = Window.partitionBy("block").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("held", F.last(F.when(F.col("kind") == 0, F.struct(*columns)), ignorenulls=True).over(w))
    ends = series.withColumn("block", block).groupBy("block").agg(F.max_by(F.struct(*columns), "ts").alias("end"))
    before = ends.select(F.col("block").alias("from"), "end")
    blocks = rows.select("block").distinct().join(before, F.col("from") < F.col("block"), "left").groupBy("block").agg(F.max_by("end", "from").alias("carried"))
    found = filled.where("kind = 1").join(blocks, "block", "left").select("ts", *[F.coalesce(F.col("held")[c], F.col("carried")[c], F.lit(0)).alias(c) for c in columns])
    return points.join(found, "ts", "left")


def five_points(segments: DataFrame) -> DataFrame:
    """Days at the start, a quarter, half and three quarters of an interval, and its end; of short intervals the first days in a row."""
    d = F.datediff("end", "start")
    steps = [F.when(d < 4, i).otherwise(F.floor(d * q)).cast("int") for i, q in ((0, 0.0), (1, 0.25), (2, 0.5), (3, 0.75))]
    return segments.select("*", F.posexplode(F.array(*[F.date_add("start", x) for x in steps], F.col("end"))).alias("point", "ts"))


def index_sums(index: DataFrame, periods: tuple[int, ...] = (4, 47)) -> DataFrame:
    """ts and s4 .. s47 of an index, one row a day; days of the warm-up leave.

    Days are numbered by year, from the counts of the years before, and every day adds its close to the sums of the days that it
    reaches, so no task orders the whole series.
    """
    longest = max(periods)
    rows = index.withColumn("block", F.year("ts"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("days"))
    before = sizes.select(F.col("block").alias("of"), "days")
    offsets = sizes.select("block").join(before, F.col("of") < F.col("block"), "left").groupBy("block").agg(F.coalesce(F.sum("days"), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("ts")) + F.col("offset")
    rows = rows.join(offsets, "block").withColumn("place", place.cast("long"))
    reach = F.posexplode(F.sequence(F.col("place"), F.col("place") + longest - 1)).alias("back", "at")
    spread = rows.select("close", "place", "ts", reach)
    sums = [F.sum(F.when(F.col("back") < k, F.col("close"))).alias(f"s{k}") for k in periods]
    found = spread.groupBy("at").agg(F.max(F.when(F.col("back") == 0, F.col("ts"))).alias("ts"), F.count("*").alias("held"), *sums)
    return found.where((F.col("held") == longest) & F.col("ts").isNotNull()).select("ts", *[f"s{k}" for k in periods])
