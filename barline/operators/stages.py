"""Rolling sums, crossing flags, runs and trend stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barline.functions.ma import by_time, PERIODS, average, falls_below, golden_cross, ordered, rises, rising_count

THRESHOLDS = {"stage1": 10, "stage2": 4, "stage3": 10, "all": 10}


def rolling_sums(bars: DataFrame, periods: tuple[int, ...] = PERIODS, warm_up: bool = False) -> DataFrame:
    """s4 .. s47 and n, the bar's number from 0 after the warm-up; bars of the warm-up leave.

    Sums cover the bars that are given: filter a range before for averages of the range, after for those of the full history. With
    warm_up its bars stay, with numbers below 0 and nulls in sums that lack bars.
    """
    longest = max(periods)
    if warm_up:
        whole = bars.withColumn("_rn", F.row_number().over(by_time()))
        sums = {f"s{k}": F.when(F.col("_rn") >= k, F.sum("close").over(by_time().rowsBetween(1 - k, 0))) for k in periods}
        return whole.withColumns(sums).withColumn("n", F.col("_rn") - longest).drop("_rn")
    numbered = bars.withColumns({"_rn": F.row_number().over(by_time())} | {f"s{k}": F.sum("close").over(by_time().rowsBetween(1 - k, 0)) for k in periods})
    return numbered.where(F.col("_rn") >= longest).withColumn("n", F.col("_rn") - longest).drop("_rn")


def flags(sums: DataFrame, periods: tuple[int, ...] = PERIODS, by: WindowSpec | None = None) -> DataFrame:
    """ordered, rc (averages that rise), r4 .. r47, s2, only4 (MA4 alone drops), joint (MA4 and another drop), p4 and p5 (MA4 falls below MA20)."""
    first, later = periods[0], F.col("n") >= 1
    out = sums.withColumns({"ordered": ordered(periods), "rc": rising_count(periods, by), **{f"r{k}": rises(k, by) for k in periods}, "p4": falls_below(4, 20, by=by), "p5": falls_below(4, 20, strict=False, by=by)})
    down = later & ~F.col(f"r{first}")
    return out.withColumns({"s2": F.col("ordered") & (F.col("rc") == len(periods)) & later, "only4": down & (F.col("rc") == len(periods) - 1), "joint": down & (F.col("rc") < len(periods) - 1)})


def islands(rows: DataFrame, flag: Column) -> DataFrame:
    """Maximal runs of consecutive bars with the flag, as `island` beside their rows."""
    return rows.where(flag).withColumn("island", F.col("n") - F.row_number().over(by_time()))


def runs(rows: DataFrame, flag: Column) -> DataFrame:
    return islands(rows, flag).groupBy("code", "island").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.min("ts").alias("start"), F.max("ts").alias("end")).drop("island")


def stage_positions(sums: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """code, stage, lo, hi (bar numbers), closed: stage1, stage2, stage3 and all, from one pass over the runs of stage 2.

    stage2 is a run of more than 3 bars in bullish arrangement with every average rising. stage1 reaches back from a run (of any
    length) to the last bar where fewer than 4 averages rise, and has more than 3 bars. stage3 follows a stage2 after which
    MA4 alone drops, up to the first bar where MA4 and another drop. all goes from stage1 to the first bar of the
    run or later where MA4 is no longer above MA20; a run that reaches the end without one goes to the last bar.
    """
    before, after = by_time().rowsBetween(Window.unboundedPreceding, -1), by_time().rowsBetween(1, Window.unboundedFollowing)
    marked = flags(sums, periods).withColumns({
        "weak": F.max(F.when((F.col("rc") < 4) & (F.col("n") >= 1), F.col("n"))).over(before),
        "next3": F.min(F.when(F.col("joint"), F.col("n"))).over(after),
        "next5": F.min(F.when(F.col("p5"), F.col("n"))).over(by_time().rowsBetween(0, Window.unboundedFollowing)),
        "qualified": F.coalesce(F.lead("only4").over(by_time()), F.lit(False)),
        "last": F.max("n").over(Window.partitionBy("code")),
    })
    found = islands(marked, F.col("s2")).groupBy("code", "island").agg(
        F.min("n").alias("a"), F.max("n").alias("b"), F.min_by("weak", "n").alias("weak"), F.max_by("next3", "n").alias("next3"),
        F.min_by("next5", "n").alias("next5"), F.max_by("qualified", "n").alias("qualified"), F.first("last").alias("last"),
    )
    return positions_of(found)


def positions_of(found: DataFrame) -> DataFrame:
    """The stages around runs a .. b, with weak, next3, next5, qualified and last as `stage_positions` has them."""
    found = found.withColumns({"j": F.coalesce(F.col("weak") + 1, F.lit(1)), "long2": F.col("b") - F.col("a") + 1 > 3}).withColumn("long1", F.col("a") - F.col("j") > 3)
    row = lambda stage, lo, hi, valid: F.struct(F.lit(stage).alias("stage"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), valid.alias("valid"))
    a, b, j, open_end = F.col("a"), F.col("b"), F.col("j"), F.col("b") == F.col("last")
    all_end = F.coalesce("next5", F.when(open_end, F.col("last")))
    stages = F.array(row("stage1", j, a - 1, F.col("long1")), row("stage2", a, b, F.col("long2")), row("stage3", b + 1, F.col("next3"), F.col("long2") & F.col("qualified") & F.col("next3").isNotNull()), row("all", j, all_end, F.col("long1") & all_end.isNotNull()))
    return found.select("code", "last", F.inline(F.filter(stages, lambda x: x["valid"]))).select("code", "stage", "lo", "hi", (F.col("hi") < F.col("last")).alias("closed"))


def bars_of(positions: DataFrame, bars: DataFrame, before: int = 0) -> DataFrame:
    """Every segment beside each of its bars, and up to `before` bars before it. Segments name their bars one by one, so the join's key is the bar and long histories spread."""
    named = positions.withColumn("n", F.explode(F.sequence(F.greatest(F.col("lo") - before, F.lit(0)), F.col("hi"))))
    return named.join(bars, ["code", "n"])


def stage_segments(sums: DataFrame, periods: tuple[int, ...] = PERIODS) -> DataFrame:
    """code, stage, lo, hi, start, end, duration (bars), duration_type (long or short), and the features of 11 and 18 numbers.

    Features: for each average (last - first) / bars, 0 for a single bar; the mean gap of neighbouring averages; the longer vector
    also has sample deviations (0 for a single bar) and the number of bars. Values are in cents. Segments that two runs share are one.
    """
    size = F.count("*")
    value = lambda by, k: by(F.col(f"s{k}"), F.col("n")) / F.lit(k)
    slopes = [F.when(size > 1, (value(F.max_by, k) - value(F.min_by, k)) / size).otherwise(0.0).alias(f"slope{k}") for k in periods]
    gaps = [F.avg(average(p) - average(q)).alias(f"gap{p}_{q}") for p, q in zip(periods, periods[1:], strict=False)]
    spread = [F.coalesce(F.stddev_samp(average(k)), F.lit(0.0)).alias(f"std{k}") for k in periods]
    out = bars_of(stage_positions(sums, periods).select("code", "stage", "lo", "hi").distinct(), sums).groupBy("code", "stage", "lo", "hi").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), size.cast("int").alias("duration"), *slopes, *spread, *gaps)
    limit = F.element_at(F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))]), F.col("stage"))
    slope, std, gap = [F.col(f"slope{k}") for k in periods], [F.col(f"std{k}") for k in periods], [F.col(f"gap{p}_{q}") for p, q in zip(periods, periods[1:], strict=False)]
    return out.select("code", "stage", "lo", "hi", "start", "end", "duration", F.when(F.col("duration") > limit, "long").otherwise("short").alias("duration_type"), F.array(*slope, *gap).alias("features11"), F.array(*slope, *std, *gap, F.col("duration").cast("double")).alias("features18"))


def context_labels(positions: DataFrame, bars: DataFrame, stage: str, label: int, context: int = 60) -> DataFrame:
    """Each segment of a stage with up to `context` bars before it (label 0) and its own bars (label)."""
    chosen = positions.where(F.col("stage") == stage).select("code", "lo", "hi")
    return bars_of(chosen, bars, context).select("code", "lo", "ts", "n", F.when(F.col("n") >= F.col("lo"), label).otherwise(0).alias("label"))


def bullish_runs(sums: DataFrame) -> DataFrame:
    """Runs in bullish arrangement with every average rising; on the very first bar the arrangement is enough. `valid`: no MA4 falls below MA20 from the run's last bar on."""
    marked = flags(sums).withColumn("next4", F.min(F.when(F.col("p4"), F.col("n"))).over(by_time().rowsBetween(1, Window.unboundedFollowing)))
    return islands(marked, F.col("s2") | (F.col("ordered") & (F.col("n") == 0))).groupBy("code", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").cast("int").alias("bars"), F.max_by("next4", "n").alias("next4")).select("code", "start", "end", "bars", F.col("next4").isNull().alias("valid"))


def end_phase_labels(sums: DataFrame, extend: int = 10) -> DataFrame:
    """Runs of two bars or more with a later fall of MA4 below MA20: their bars 2, those up to the fall 4, and 0 for `extend` calendar days around."""
    marked = flags(sums).withColumn("next4", F.min(F.when(F.col("p4"), F.struct("n", "ts"))).over(by_time().rowsBetween(1, Window.unboundedFollowing)))
    found = islands(marked, F.col("s2")).groupBy("code", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("bars"), F.max_by("next4", "n").alias("fall"))
    found = found.where("bars >= 2 and fall is not null").select("code", "start", "end", F.col("fall.ts").alias("fall"))
    days = found.withColumn("ts", F.explode(F.sequence(F.date_sub("start", extend), F.date_add("fall", extend)))).join(sums.select("code", "ts"), ["code", "ts"])
    return days.select("code", "start", "ts", F.when(F.col("ts").between(F.col("start"), F.col("end")), 2).when((F.col("ts") > F.col("end")) & (F.col("ts") <= F.col("fall")), 4).otherwise(0).alias("label"))


def calendar_islands(rows: DataFrame, gap: int = 1) -> DataFrame:
    """Rows of a code whose days are at most `gap` calendar days apart, as runs: code, start, end, bars and last, the number of the last bar."""
    new = F.when(F.datediff("ts", F.lag("ts").over(by_time())) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(by_time())).groupBy("code", "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").cast("int").alias("bars"), F.max("n").alias("last")).drop("_run")


def golden_cross_bars(sums: DataFrame, short: int = 4, long: int = 12, arranged: bool = True) -> DataFrame:
    """Bars with a golden cross and more volume than before and, past bar 10, a higher close than 9 bars before; in bullish arrangement."""
    volume = F.coalesce(F.col("vol") > F.lag("vol").over(by_time()), F.lit(True))
    trend = (F.col("n") <= 10) | F.coalesce(F.col("close") > F.lag("close", 9).over(by_time()), F.lit(False))
    kept = sums.withColumns({"_cross": golden_cross(short, long), "_up": volume & trend}).where("_cross and _up").drop("_cross", "_up")
    return kept.where(ordered()) if arranged else kept
