"""Which stage a window of days is in, by three rules, and searches that start from such a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions import scalars
from barline.functions.ma import PERIODS
from barline.operators.stages import THRESHOLDS, flags, rolling_sums

RULES = ("live", "second", "backup")


def window_verdicts(windows: DataFrame, bars: DataFrame, around: int = 100) -> DataFrame:
    """windows (code, start, end) with their number of bars and a stage by each rule: live, second, backup.

    Averages come from the bars within `around` calendar days of the window, so the first 46 of those are their warm-up. Tests begin at a
    window's second bar.
    live: stage3 if in the days before MA4 alone dropped and no joint drop follows in the window; stage2 if arranged and rising; stage1 if
    four averages rise; the last two need more than 3 bars.
    second: stage3 if four averages rise on every bar and a joint drop comes on the last bar and on no other; stage2 and stage1 of any length.
    backup: as second, but stage3 needs an earlier drop of MA4 alone, too.
    Windows of fewer than 2 bars are unknown. Each window names its days, so the join's key is a code's day.
    """
    marked = flags(rolling_sums(bars, warm_up=True)).select("code", "ts", "s2", "rc", "only4", "joint")
    asked = windows.select("code", "start", "end").distinct()
    days = asked.withColumn("ts", F.explode(F.sequence(F.date_sub("start", around), F.date_add("end", around)))).join(marked, ["code", "ts"])
    by = Window.partitionBy("code", "start", "end")
    days = days.withColumn("r", F.row_number().over(by.orderBy("ts"))).where(F.col("r") >= max(PERIODS))
    target = F.col("ts").between(F.col("start"), F.col("end"))
    days = days.withColumn("place", F.when(target, F.row_number().over(Window.partitionBy("code", "start", "end", target).orderBy("ts")) - 1))
    tested = F.col("place") >= 1
    last = F.max("place").over(by)
    days = days.withColumn("last", last)
    every = lambda c: F.coalesce(F.bool_and(F.when(tested, c)), F.lit(True))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    got = days.groupBy("code", "start", "end").agg(
        F.count("place").cast("int").alias("bars"),
        some((F.col("ts") < F.col("start")) & (F.col("r") > max(PERIODS)) & F.col("only4")).alias("dropped"),
        every(~F.col("joint")).alias("whole"),
        every(F.col("s2")).alias("two"),
        every(F.col("rc") >= 4).alias("one"),
        some(tested & F.col("joint") & (F.col("place") < F.col("last"))).alias("early"),
        some(tested & F.col("joint") & (F.col("place") == F.col("last"))).alias("late"),
    )
    long, enough = F.col("bars") > 3, F.col("bars") >= 2
    pick = lambda three, two, one: F.when(enough & three, "stage3").when(enough & two, "stage2").when(enough & one, "stage1").otherwise("unknown")
    c = F.col
    ends = c("one") & ~c("early") & c("late")
    got = got.withColumns({"live": pick(c("dropped") & c("whole"), c("two") & long, c("one") & long), "second": pick(ends, c("two"), c("one")), "backup": pick(ends & c("dropped"), c("two"), c("one"))})
    found = windows.join(got.select("code", "start", "end", "bars", *RULES), ["code", "start", "end"], "left")
    return found.withColumns({"bars": F.coalesce("bars", F.lit(0)), **{r: F.coalesce(r, F.lit("unknown")) for r in RULES}})


def latest_windows(bars: DataFrame, length: int = 10) -> DataFrame:
    """The days of each code's last `length` bars: code, start, end; codes with fewer bars leave."""
    back = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("ts")))
    return bars.select("code", "ts", back.alias("back")).where(F.col("back") <= length).groupBy("code").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars")).where(F.col("bars") == length).drop("bars")


def duration_type(stage: Column, bars: Column) -> Column:
    limit = F.element_at(F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))]), stage)
    return F.when(bars > limit, "long").otherwise("short")


def same_stage(window: DataFrame, bars: DataFrame, segments: DataFrame, rule: str = "live") -> DataFrame:
    """Segments of the stage that the rule finds for one window (code, start, end), and whether they are long or short as it is: code, stage, lo, hi, duration_type, same_type. An unknown window gives no rows."""
    one = window_verdicts(window, bars).select(F.col(rule).alias("stage"), duration_type(F.col(rule), F.col("bars")).alias("own")).where("stage <> 'unknown'")  # one row
    return segments.join(F.broadcast(one), "stage").select("code", "stage", "lo", "hi", "duration_type", (F.col("duration_type") == F.col("own")).alias("same_type"))


def similar_stages(window: DataFrame, bars: DataFrame, segments: DataFrame, features: Column, least: float = 0.8, rule: str = "second") -> DataFrame:
    """Segments of the window's stage whose features are close to the given ones, best first: code, stage, lo, hi, similarity. The window is one row (code, start, end)."""
    one = window_verdicts(window.withColumn("wanted", features), bars).select(F.col(rule).alias("stage"), "wanted")
    both = segments.join(F.broadcast(one), "stage").withColumn("similarity", F.round(scalars.cosine(F.col("features18"), F.col("wanted")), 6))
    return both.where(F.col("similarity") >= least).select("code", "stage", "lo", "hi", "similarity").orderBy(F.desc("similarity"), "code", "lo", "hi")


def with_probabilities(segments: DataFrame, probabilities: DataFrame | None = None) -> DataFrame:
    """Segments with the map of class probabilities (code, stage, lo, hi, probabilities) that a classifier gave them; an empty map where it gave none."""
    if probabilities is None:
        return segments.withColumn("probabilities", F.create_map().cast("map<string,double>"))
    found = segments.join(probabilities.select("code", "stage", "lo", "hi", "probabilities"), ["code", "stage", "lo", "hi"], "left")
    return found.withColumn("probabilities", F.coalesce("probabilities", F.create_map().cast("map<string,double>")))
