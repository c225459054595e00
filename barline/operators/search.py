"""Reports of a pattern search: similar windows with what follows them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.patterns import similar_windows
from barline.operators.returns import forward_returns


RANKED = 1 << 16  # bars of a code whose windows are ranked in one group


def pattern_report(sums: DataFrame, code: str, lo: int, length: int = 10, least: float = 0.7, future: int = 5, stride: int = 2) -> DataFrame:
    """Windows at least `least` similar to the pattern, which has 5 bars or more: code, lo, hi, start, end, similarity, and the returns of the next `future` bars."""
    if length < 5:
        raise ValueError("a pattern has 5 bars or more")
    found = similar_windows(sums, code, lo, length, stride).where(F.col("similarity") >= least)
    found = found.select("code", F.col("start").cast("long").alias("lo"), (F.col("start") + length - 1).cast("long").alias("hi"), "similarity")
    days = sums.select("code", F.col("n").cast("long").alias("n"), "ts")
    dated = found.join(days.select("code", F.col("n").alias("lo"), F.col("ts").alias("start")), ["code", "lo"]).join(days.select("code", F.col("n").alias("hi"), F.col("ts").alias("end")), ["code", "hi"])
    return dated.join(forward_returns(found, sums, future), ["code", "lo", "hi"])


def ranked(report: DataFrame, per_code: int | None = None, digits: int = 2) -> DataFrame:
    """The report with `rank`, by the similarity as it is shown, rounded, then by code and start; with per_code, the best of each code, ranked there."""
    shown = report.withColumn("similarity", F.round(F.col("similarity") + 1e-9, digits))
    order = [F.desc("similarity"), "code", "lo"]
    if per_code is None:
        # Ranks of all rows without one task for all: a place in each shown similarity's rows of a code, RANKED bars at a time, after the counts of what comes before.
        shown = shown.withColumn("_part", F.expr(f"lo div {RANKED}"))
        keys = ["similarity", "code", "_part"]
        counts = shown.groupBy(*keys).count()
        along = Window.partitionBy("similarity").orderBy("code", "_part").rowsBetween(Window.unboundedPreceding, -1)
        # There are 10 ** digits shown values at most.
        sizes = counts.groupBy("similarity").agg(F.sum("count").alias("rows"))
        higher = sizes.alias("a").join(sizes.alias("b"), F.col("b.similarity") > F.col("a.similarity"), "left").groupBy(F.col("a.similarity").alias("similarity")).agg(F.coalesce(F.sum("b.rows"), F.lit(0)).alias("above"))
        before = counts.withColumn("_before", F.coalesce(F.sum("count").over(along), F.lit(0))).join(F.broadcast(higher), "similarity").select(*keys, (F.col("above") + F.col("_before")).alias("above"))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("lo"))
        return shown.withColumn("rank", place).join(before, keys).withColumn("rank", (F.col("above") + F.col("rank")).cast("long")).drop("above", "_part").select(*report.columns, "rank")
    place = F.row_number().over(Window.partitionBy("code").orderBy(*order))
    return shown.withColumn("rank", place.cast("long")).where(F.col("rank") <= per_code)


def overall_return(report: DataFrame) -> DataFrame:
    """One row: windows, and the mean of their mean returns, those without later bars left out; 0 if there are none."""
    return report.agg(F.count("*").alias("windows"), F.round(F.coalesce(F.avg(F.when(F.col("n_future") > 0, F.col("mean_return"))), F.lit(0.0)), 4).alias("mean_return"))
