"""Positions of days in a series, and the bars before, in and after a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.ma import by_time
from barline.operators.stages import THRESHOLDS, bars_of


def last_bars(points: DataFrame, bars: DataFrame, day: str = "ts") -> DataFrame:
    """points (code and a day) with `n`, the number of the code's last bar at or before the day; null if there is none. One window over both tables, no range join."""
    asked = points.select("code", F.col(day).alias("ts")).distinct().select("code", "ts", F.lit(None).cast("long").alias("n"), F.lit(1).alias("kind"))
    both = bars.select("code", "ts", F.col("n").cast("long").alias("n"), F.lit(0).alias("kind")).unionByName(asked)
    held = F.last("n", ignorenulls=True).over(Window.partitionBy("code").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("held", held).where("kind = 1").select("code", F.col("ts").alias(day), F.col("held").alias("n"))
    return points.join(found, ["code", day])


def inside(ranges: DataFrame, bars: DataFrame) -> DataFrame:
    """ranges (code, start, end) with lo and hi, their first bar at or after the start and their last at or before the end; ranges without a bar leave."""
    found = last_bars(ranges.withColumn("_before", F.date_sub("start", 1)), bars, "_before").withColumn("lo", F.coalesce(F.col("n") + 1, F.lit(0)).cast("long")).drop("n", "_before")
    return last_bars(found, bars, "end").withColumnRenamed("n", "hi").where("hi >= lo")


def with_history(ranges: DataFrame, bars: DataFrame, history: int = 50) -> DataFrame:
    """The bars of each range and up to `history` bars before it: code, start, end, ts, n, part ('history' or 'target') and the bars of both parts."""
    rows = bars_of(inside(ranges, bars), bars.select("code", "ts", F.col("n").cast("long").alias("n")), history)
    target = F.col("n") >= F.col("lo")
    by = Window.partitionBy("code", "start", "end")
    rows = rows.withColumns({"n_history": F.sum(F.when(target, 0).otherwise(1)).over(by), "n_target": F.sum(F.when(target, 1).otherwise(0)).over(by)})
    return rows.select("code", "start", "end", "ts", "n", F.when(target, "target").otherwise("history").alias("part"), "n_history", "n_target")


def before_first(labelled: DataFrame, history: int = 60) -> DataFrame:
    """Of labelled bars (code, ts, n, label), the first bar of each label other than 0, and the up to `history` bars before it, itself left out; labels without such bars leave: code, label, first, n."""
    first = labelled.where("label <> 0").groupBy("code", "label").agg(F.min("n").cast("long").alias("first"))
    named = first.where("first > 0").withColumn("n", F.explode(F.sequence(F.greatest(F.col("first") - history, F.lit(0)), F.col("first") - 1)))
    return named.join(labelled.select("code", F.col("n").cast("long").alias("n")).distinct(), ["code", "n"]).select("code", "label", "first", "n")


def classifier_rows(labelled: DataFrame, history: int = 60) -> DataFrame:
    """Of labelled bars (code, ts, n, label) what a classifier of each label is given: the bars before its first one, up to `history`, and all from its first to its last.

    code, label, n, part ('history' or 'target'), duration (bars of the target) and duration_type, by which a model is chosen. Labels without a bar before leave.
    """
    ends = labelled.where("label <> 0").groupBy("code", "label").agg(F.min("n").cast("long").alias("lo"), F.max("n").cast("long").alias("hi"))
    rows = bars_of(ends, labelled.select("code", F.col("n").cast("long").alias("n")).distinct(), history)
    target = F.col("n") >= F.col("lo")
    by = Window.partitionBy("code", "label")
    rows = rows.withColumns({"duration": F.count_if(target).over(by), "before": F.count_if(~target).over(by)}).where("before > 0")
    kind = F.when(F.col("duration") > F.when(F.col("label") == 2, THRESHOLDS["stage2"]).otherwise(THRESHOLDS["stage1"]), "long").otherwise("short")
    return rows.select("code", "label", "n", F.when(target, "target").otherwise("history").alias("part"), "duration", kind.alias("duration_type"))


def on_days(bars: DataFrame, days: DataFrame) -> DataFrame:
    """The bars on the days of a table (ts), whatever their code."""
    return bars.join(days.select("ts").distinct(), "ts", "left_semi")


def with_labels(bars: DataFrame, labelled: DataFrame) -> DataFrame:
    """The bars that a labelled table (code, ts, label) has, with its label; codes are equal if their first six characters are."""
    key = lambda c: F.substring(c, 1, 6)
    marks = labelled.select(key("code").alias("_key"), "ts", "label").distinct()
    return bars.withColumn("_key", key("code")).join(marks, ["_key", "ts"]).drop("_key")


def export_rows(fragments: DataFrame, bars: DataFrame, label: int | Column, history: int = 60) -> DataFrame:
    """What is exported of each code's one fragment (code, start, end): its bars from `history` before the bar at or before its start to the end of the series; those of the fragment have the label, others 0."""
    found = last_bars(fragments, bars, "start").withColumnRenamed("n", "at")
    rows = bars.select("code", "ts", F.col("n").cast("long").alias("n")).join(found, "code").where(F.col("n") >= F.coalesce("at", F.lit(0)) - history)
    mark = F.when(F.col("ts").between(F.col("start"), F.col("end")), label).otherwise(0)
    return rows.select("code", "ts", "n", mark.cast("int").alias("label"))


def calendar_tail(bars: DataFrame, days: int, today: Column) -> DataFrame:
    """The bars of the last `days` calendar days before `today`, which the caller gives, so that a query repeats."""
    return bars.where(F.col("ts") >= F.date_sub(today, days))


def head(bars: DataFrame, rows: int = 40) -> DataFrame:
    """The first bars of each code."""
    return bars.withColumn("_r", F.row_number().over(by_time())).where(F.col("_r") <= rows).drop("_r")


def first_name(bars: DataFrame, column: str = "name") -> DataFrame:
    """code and its first name that is not null, by time."""
    return bars.groupBy("code").agg(F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("ts"))).alias(column))


def named(rows: DataFrame, names: DataFrame, column: str = "name") -> DataFrame:
    """rows with the code's name; a code without one is its own name."""
    return rows.join(names.select("code", column), "code", "left").withColumn(column, F.coalesce(column, "code"))


def five_bar_windows(sums: DataFrame, length: int = 5) -> DataFrame:
    """Every window of `length` bars at every place: code, lo, start, end; incomplete ones leave."""
    w = by_time().rowsBetween(0, length - 1)
    rows = sums.select("code", F.col("n").alias("lo"), F.col("ts").alias("start"), F.max("ts").over(w).alias("end"), F.count("*").over(w).alias("bars"))
    return rows.where(F.col("bars") == length).drop("bars")
