"""Golden-cross intervals with what surrounds and follows them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.ma import by_time, golden_cross, ordered
from barline.operators import blocks
from barline.operators.returns import as_of, five_points, forward_returns
from barline.operators.stages import calendar_islands


def matching_bars(sums: DataFrame, predicate: Column | Callable[[], Column], arranged: bool = True, filtered: bool = True) -> DataFrame:
    """Bars that meet a predicate, an expression over the sums or a function that gives one; more volume than the bar before and, past bar 10, a higher close than 9 bars before; in bullish arrangement."""
    hit = F.coalesce(predicate() if callable(predicate) else predicate, F.lit(False))
    if filtered:
        volume = F.coalesce(F.col("vol") > F.lag("vol").over(by_time()), F.lit(True))
        hit = hit & volume & ((F.col("n") <= 10) | F.coalesce(F.col("close") > F.lag("close", 9).over(by_time()), F.lit(False)))
    if arranged:
        hit = hit & ordered()
    return sums.withColumn("_hit", hit).where("_hit").drop("_hit")


def python_matches(sums: DataFrame, predicate: Callable[[pd.DataFrame], bool], prefix: int, block: int = 4096) -> DataFrame:
    """Bars for which a Python function is true of the `prefix` bars that end with it (fewer at a series' start), in order.

    Blocks of bars, each with the bars before it, are the groups, so a function sees what it asks for and no task holds a series. Expressions need none of this.
    """
    rows = blocks.around(sums.withColumn("block", F.expr(f"n div {block}")), prefix - 1, 0, block)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("n", ignore_index=True)
        hit = [i for i in range(len(group)) if group["own"].iat[i] and predicate(group.iloc[max(0, i - prefix + 1) : i + 1])]
        return group.iloc[hit]

    return rows.groupBy("code", "block").applyInPandas(run, rows.schema).select(*sums.columns)


def matching_intervals(sums: DataFrame, index: DataFrame, predicate: Column | Callable[[], Column] | None = None, arranged: bool = True, extend: int = 3, min_days: int = 1, after: int = 30, older: bool = False) -> DataFrame:
    """Runs of matching bars at most a day apart, one row each: code, k (place in the code's time order), start, end, the days from `extend` before to `extend` after with
    their number of bars, the number of bars in the `after` days that follow, the mean return of the next 5 bars (0 without any), and the index's
    averages (sums s4 and s47 as of five days) over both stretches. The default predicate is the cross of 4 above 12.

    The older search takes every bar of the cross of 4 above 20, and its return is that of `close_to_close`, null without a later bar.
    """
    if older:
        hits = matching_bars(sums, golden_cross(4, 20) if predicate is None else predicate, arranged=False, filtered=False)
    else:
        hits = matching_bars(sums, golden_cross(4, 12) if predicate is None else predicate, arranged)
    runs = calendar_islands(hits).where((F.col("bars") >= min_days) & (F.datediff("end", "start") + 1 >= min_days))
    runs = runs.withColumns({"lo": F.col("last").cast("long"), "hi": F.col("last").cast("long"), "ext_start": F.date_sub("start", extend), "ext_end": F.date_add("end", extend)})
    keys = ["code", "lo"]
    if older:
        returns = runs.select(*keys, "start", "end").join(close_to_close(runs, sums), ["code", "start", "end"]).select(*keys, F.col("mean_step").alias("five_day_return"))
    else:
        returns = forward_returns(runs, sums).select(*keys, F.col("mean_return").alias("five_day_return"))
    day = F.explode(F.sequence("ext_start", F.date_add("end", after)))
    bars = runs.select(*keys, "ext_start", "ext_end", "end", day.alias("ts")).join(sums.select("code", "ts"), ["code", "ts"])
    counted = bars.groupBy(*keys).agg(F.count_if(F.col("ts") <= F.col("ext_end")).alias("bars_around"), F.count_if(F.col("ts") > F.col("end")).alias("bars_after"))
    around = runs.select(*keys, F.lit("around").alias("part"), F.col("ext_start").alias("start"), F.col("ext_end").alias("end"))
    later = runs.select(*keys, F.lit("after").alias("part"), F.date_add("end", 1).alias("start"), F.date_add("end", after).alias("end"))
    points = as_of(five_points(around.unionByName(later)), index, ["s4", "s47"])
    cells = [F.max(F.when((F.col("part") == p) & (F.col("point") == i), F.col(s))).alias(f"{p}_{s}_{i}") for p in ("around", "after") for s in ("s4", "s47") for i in range(5)]
    values = points.groupBy(*keys).agg(*cells)
    k = F.row_number().over(Window.partitionBy("code").orderBy("start"))
    found = runs.withColumn("k", k).join(returns, keys).join(counted, keys, "left").join(values, keys)
    return found.drop("lo", "hi", "last", "bars").fillna(0, ["bars_around", "bars_after"])


def first_intervals(found: DataFrame, per_code: int = 5, older: bool = False) -> DataFrame:
    """The first intervals of each code, and beside each the plain mean of all intervals' returns, those without later bars as 0; in the older search these are left out of the mean."""
    value = F.col("five_day_return") if older else F.coalesce("five_day_return", F.lit(0.0))
    overall = found.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("overall_return"))  # one row
    return found.where(F.col("k") <= per_code).fillna(0.0, ["five_day_return"]).crossJoin(F.broadcast(overall))


def close_to_close(runs: DataFrame, sums: DataFrame, days: int = 5) -> DataFrame:
    """The older measure: of each run (code, start, end, last) the mean of the close's steps over `days` bars from its last bar on, as a fraction; null for a run without a later bar."""
    named = runs.select("code", "start", "end", F.explode(F.sequence(F.col("last"), F.col("last") + days - 1)).alias("n"))
    steps = sums.select("code", "n", (F.col("close") / F.lag("close").over(by_time()) - 1).alias("step"))
    rows = named.join(steps, ["code", "n"])
    first = F.min("n").over(Window.partitionBy("code", "start", "end"))
    return rows.withColumn("first", first).groupBy("code", "start", "end").agg(F.avg(F.when(F.col("n") > F.col("first"), F.col("step"))).alias("mean_step"))
