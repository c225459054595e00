"""The engine's registered queries; each takes (spark, sf_dir)."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.ma import PERIODS, by_time, death_cross, falls_below, golden_cross, ordered
from barline.operators import blocks, golden, history, indicators, learning, patterns, returns, screen, search, stages, symbolic, verdicts
from barline.sources import bars as sources
from barline.sources.store import cut

CODE, LO = "Brand#11", 60  # the pattern and target series of the search queries
QUERIES = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.rolling_sums(sources.walk(spark, sf_dir))


@_query
def bars_daily(spark, sf_dir):
    return sources.daily(spark, sf_dir)


@_query
def bars_walk(spark, sf_dir):
    return sources.walk(spark, sf_dir)


@_query
def ma_sums(spark, sf_dir):
    return _sums(spark, sf_dir).select("code", "ts", F.col("n").cast("int").alias("n"), *[f"s{k}" for k in PERIODS])


@_query
def ma_flags(spark, sf_dir):
    return stages.flags(_sums(spark, sf_dir)).select("code", "ts", "ordered", "rc", "s2", "only4", "joint", "p4", "p5")


@_query
def crosses(spark, sf_dir):
    rows = _sums(spark, sf_dir).withColumns({"golden": golden_cross(4, 12), "death": death_cross(4, 12), "below": falls_below(4, 20), "not_above": falls_below(4, 20, strict=False)})
    return rows.where("golden or death or below or not_above").select("code", "ts", "golden", "death", "below", "not_above")


@_query
def bullish_bars(spark, sf_dir):
    return _sums(spark, sf_dir).where(ordered()).select("code", "ts")


@_query
def bullish_runs(spark, sf_dir):
    return stages.bullish_runs(_sums(spark, sf_dir))


@_query
def last_bullish_run(spark, sf_dir):
    runs = stages.bullish_runs(_sums(spark, sf_dir)).where("valid")
    return runs.groupBy("code").agg(F.max_by("start", "end").alias("start"), F.max("end").alias("end"))


@_query
def stage_positions(spark, sf_dir):
    return stages.stage_positions(_sums(spark, sf_dir))


@_query
def stage_features(spark, sf_dir):
    # The small addend keeps exact halves from rounding by the last bit of a sum.
    found = stages.stage_segments(_sums(spark, sf_dir))
    return found.select("code", "stage", "lo", "hi", "start", "end", "duration", "duration_type", *[F.round(F.get("features18", i) + 1e-6, 2).alias(f"f{i}") for i in range(18)])


@_query
def stage_features11(spark, sf_dir):
    found = stages.stage_segments(_sums(spark, sf_dir))
    return found.select("code", "stage", "lo", "hi", *[F.round(F.get("features11", i) + 1e-6, 2).alias(f"f{i}") for i in range(11)])


@_query
def stage_summary(spark, sf_dir):
    return stages.stage_segments(_sums(spark, sf_dir)).groupBy("stage", "duration_type").agg(F.count("*").alias("segments"), F.sum("duration").alias("bars"))


@_query
def stage_context(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    return stages.context_labels(stages.stage_positions(sums), sums, "stage2", 2).select("code", "lo", "ts", "label")


@_query
def end_phase(spark, sf_dir):
    return stages.end_phase_labels(_sums(spark, sf_dir))


@_query
def calendar_runs(spark, sf_dir):
    return stages.calendar_islands(_sums(spark, sf_dir).where(ordered())).drop("last")


@_query
def golden_cross_bars(spark, sf_dir):
    return stages.golden_cross_bars(_sums(spark, sf_dir), arranged=False).select("code", "ts", "close")


@_query
def golden_cross_arranged(spark, sf_dir):
    return golden.matching_bars(_sums(spark, sf_dir), lambda: golden_cross(4, 8)).select("code", "ts", "close")


def _index(bars: DataFrame) -> DataFrame:
    return returns.index_sums(sources.index_series(bars))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = sources.walk(spark, sf_dir)
    return golden.matching_intervals(stages.rolling_sums(bars), _index(bars), golden_cross(4, 8))


@_query
def golden_cross_intervals(spark, sf_dir):
    return golden.first_intervals(_intervals(spark, sf_dir)).withColumn("overall_return", F.round("overall_return", 6))


@_query
def golden_cross_older(spark, sf_dir):
    """Intervals of plain crosses of 4 above 20, by the older measure."""
    sums = _sums(spark, sf_dir)
    runs = stages.calendar_islands(golden.matching_bars(sums, golden_cross(4, 20), arranged=False, filtered=False))
    return golden.close_to_close(runs, sums).withColumn("mean_step", F.round("mean_step", 9))


@_query
def golden_cross_default(spark, sf_dir):
    """Bars of the cross of 4 above 12 with more volume, a higher close and the arrangement."""
    return golden.matching_bars(_sums(spark, sf_dir), golden_cross(4, 12)).select("code", "ts", "close")


@_query
def golden_cross_function(spark, sf_dir):
    """Bars at which a Python function of two bars finds a cross of 4 above 12."""
    crossed = lambda bars: len(bars) == 2 and bars["s4"].iat[0] * 12 <= bars["s12"].iat[0] * 4 and bars["s4"].iat[1] * 12 > bars["s12"].iat[1] * 4
    return golden.python_matches(_sums(spark, sf_dir).select("code", "ts", "n", "s4", "s12"), crossed, 2).select("code", "ts")


@_query
def golden_cross_older_intervals(spark, sf_dir):
    """The older search whole: plain crosses of 4 above 20 with the index around and after, later bars, and the mean of all returns that have any."""
    bars = sources.walk(spark, sf_dir)
    found = golden.first_intervals(golden.matching_intervals(stages.rolling_sums(bars), _index(bars), older=True), older=True)
    return found.withColumns({"five_day_return": F.round("five_day_return", 9), "overall_return": F.round("overall_return", 9)})


@_query
def forward_returns(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    return returns.forward_returns(stages.stage_positions(sums).where("stage = 'stage2'"), sums)


@_query
def overall_forward_return(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    found = returns.forward_returns(stages.stage_positions(sums).where("stage = 'stage2'"), sums)
    return found.agg(F.count("*").alias("segments"), F.round(F.avg(F.when(F.col("n_future") > 0, F.col("mean_return"))), 4).alias("mean_return"))


@_query
def index_asof(spark, sf_dir):
    bars = sources.walk(spark, sf_dir)
    sums, index = stages.rolling_sums(bars), _index(bars)
    points = returns.five_points(stages.stage_segments(sums).where("stage = 'stage2'").select("code", "lo", "start", "end"))
    return returns.as_of(points, index, ["s4", "s47"]).select("code", "lo", "point", "ts", "s4", "s47")


@_query
def pattern_similarity(spark, sf_dir):
    return patterns.similar_windows(_sums(spark, sf_dir), CODE, LO)


@_query
def pattern_top_per_code(spark, sf_dir):
    return patterns.top_per_code(patterns.similar_windows(_sums(spark, sf_dir), CODE, LO)).select("code", "start", "similarity", "rank")


@_query
def line_similarity(spark, sf_dir):
    return patterns.line_similarities(patterns.series(_sums(spark, sf_dir)), CODE).drop("dtw", "spearman")


@_query
def line_similarity_warped(spark, sf_dir):
    return patterns.line_similarities(patterns.series(_sums(spark, sf_dir)), CODE).select("code", "dtw", "spearman")


@_query
def crossover_similarity(spark, sf_dir):
    return patterns.crossover_similarity(patterns.series(_sums(spark, sf_dir)), CODE)


@_query
def group_similarity(spark, sf_dir):
    return patterns.group_similarity(patterns.series(_sums(spark, sf_dir)), CODE)


@_query
def group_similarity_older(spark, sf_dir):
    return patterns.older_group_similarity(patterns.series(_sums(spark, sf_dir)), CODE)


@_query
def group_similarity_uneven(spark, sf_dir):
    """Against a target of 20 bars, series of 13: the shorter lines are resampled; weights of the caller, golden crosses as alike."""
    sums = _sums(spark, sf_dir)
    short = patterns.series(sums, 13).where(F.col("code") != CODE)
    rows = short.unionByName(patterns.series(sums).where(F.col("code") == CODE))
    return patterns.group_similarity(rows, CODE, 25, {"direction": 1, "slope": 2, "volatility": 1, "pearson": 2, "mean_level": 1}, {"lines": 3, "crossover": 1}, {"death_count": 2, "golden_count": 1, "golden_position": 1}, golden=False)


@_query
def pattern_report(spark, sf_dir):
    found = search.ranked(search.pattern_report(_sums(spark, sf_dir), CODE, LO))
    return found.select("code", "lo", "start", "end", "similarity", "mean_return", "max_drawdown", "max_rise", "max_fall", "win_rate", "rank")


@_query
def pattern_overall_return(spark, sf_dir):
    return search.overall_return(search.pattern_report(_sums(spark, sf_dir), CODE, LO))


@_query
def pattern_report_older(spark, sf_dir):
    """Ten windows a code, with 30 bars ahead."""
    found = search.ranked(search.pattern_report(_sums(spark, sf_dir), CODE, LO, future=30), per_code=10)
    return found.select("code", "lo", "similarity", "n_future", "mean_return", "rank")


@_query
def same_stage_cosine(spark, sf_dir):
    return patterns.same_stage_cosine(stages.stage_segments(_sums(spark, sf_dir)), CODE, "stage1", -1.0).withColumn("similarity", F.round("similarity", 4))


@_query
def same_stage_close(spark, sf_dir):
    """Segments of the stage at least 0.8 alike."""
    return patterns.same_stage_cosine(stages.stage_segments(_sums(spark, sf_dir)), CODE, "stage1").withColumn("similarity", F.round("similarity", 4))


def _first_segment(segments: DataFrame, stage: str) -> DataFrame:
    own = segments.where((F.col("code") == CODE) & (F.col("stage") == stage))
    return own.agg(F.min_by(F.struct("code", "start", "end", "features18"), F.struct("lo", "hi")).alias("w")).select("w.*").where("code is not null")


@_query
def similar_stages(spark, sf_dir):
    bars = sources.walk(spark, sf_dir)
    segments = stages.stage_segments(stages.rolling_sums(bars))
    return verdicts.similar_stages(_first_segment(segments, "stage1"), bars, segments, F.col("features18")).withColumn("similarity", F.round("similarity", 4))


@_query
def same_stage_split(spark, sf_dir):
    bars = sources.walk(spark, sf_dir)
    segments = stages.stage_segments(stages.rolling_sums(bars))
    return verdicts.same_stage(_first_segment(segments, "stage1").drop("features18"), bars, segments, "second")


@_query
def window_verdicts(spark, sf_dir):
    """All segments as windows, judged by the three rules."""
    bars = sources.walk(spark, sf_dir)
    windows = stages.stage_segments(stages.rolling_sums(bars)).select("code", "stage", "lo", "hi", "start", "end")
    return verdicts.window_verdicts(windows, bars)


@_query
def window_stage(spark, sf_dir):
    bars = sources.walk(spark, sf_dir)
    return verdicts.window_verdicts(verdicts.latest_windows(bars), bars)


@_query
def screen_stage2(spark, sf_dir):
    return screen.recent_windows(_sums(spark, sf_dir), 30, 3, 2)


@_query
def screen_stage1(spark, sf_dir):
    return screen.recent_windows(_sums(spark, sf_dir), 30, 3, 1)


@_query
def screen_latest(spark, sf_dir):
    return screen.current_stage(_sums(spark, sf_dir))


@_query
def screen_two_spans(spark, sf_dir):
    """Stage 2 in the last 20 bars, stage 1 in the last 30."""
    return screen.current_stage(_sums(spark, sf_dir), 20, 3, 30)


@_query
def screen_export(spark, sf_dir):
    """The exported bars of every code that the screen finds, and the history before the first labelled one."""
    sums = _sums(spark, sf_dir)
    found = screen.current_stage(sums).select("code", "start", "end", F.substring("stage", 6, 1).cast("int").alias("k"))
    return history.export_rows(found, sums, F.col("k"))


@_query
def screen_history(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    found = screen.current_stage(sums).select("code", "start", "end", F.substring("stage", 6, 1).cast("int").alias("k"))
    return history.before_first(history.export_rows(found, sums, F.col("k")))


@_query
def classifier_rows(spark, sf_dir):
    sums = _sums(spark, sf_dir)
    found = screen.current_stage(sums).select("code", "start", "end", F.substring("stage", 6, 1).cast("int").alias("k"))
    return history.classifier_rows(history.export_rows(found, sums, F.col("k")))


@_query
def bars_on_cross_days(spark, sf_dir):
    """The bars of all codes on the days on which the chosen one has a golden cross."""
    sums = _sums(spark, sf_dir)
    days = golden.matching_bars(sums, golden_cross(4, 12), arranged=False, filtered=False).where(F.col("code") == CODE)
    return history.on_days(sums, days).select("code", "ts", "close")


@_query
def labelled_days(spark, sf_dir):
    """Bars with the labels of segments whose codes have a suffix."""
    sums = _sums(spark, sf_dir)
    marks = stages.context_labels(stages.stage_positions(sums), sums, "stage2", 2, 0).withColumn("code", F.concat(F.substring("code", 1, 6), F.lit(".X")))
    return history.with_labels(sums.withColumn("code", F.substring("code", 1, 6)), marks).select("code", "ts", "close", "label")


@_query
def range_history(spark, sf_dir):
    """Every stage2 segment widened by a day on both sides: the bars inside and the 50 before."""
    sums = _sums(spark, sf_dir)
    found = stages.stage_segments(sums).where("stage = 'stage2'").select("code", F.date_sub("start", 1).alias("start"), F.date_add("end", 1).alias("end"))
    return history.with_history(found, sums)


@_query
def five_bar_windows(spark, sf_dir):
    return history.five_bar_windows(_sums(spark, sf_dir))


@_query
def warm_up_sums(spark, sf_dir):
    return stages.rolling_sums(sources.walk(spark, sf_dir), warm_up=True).select("code", "ts", F.col("n").cast("int").alias("n"), *[f"s{k}" for k in PERIODS])


@_query
def calendar_tail(spark, sf_dir):
    """The last 90 calendar days before the newest day of all codes."""
    bars = sources.walk(spark, sf_dir)
    today = bars.agg(F.max("ts").alias("today"))  # one row
    return history.calendar_tail(bars.crossJoin(F.broadcast(today)), 90, F.col("today")).select("code", "ts", "close")


@_query
def head_bars(spark, sf_dir):
    return history.head(sources.walk(spark, sf_dir)).select("code", "ts", "close")


@_query
def label_summary(spark, sf_dir):
    """Of each stage and duration type: segments, bars, calendar days, and the day of the first."""
    found = stages.stage_segments(_sums(spark, sf_dir)).withColumn("days", F.datediff("end", "start") + 1)
    return found.groupBy("stage").agg(F.count_if(F.col("duration_type") == "long").alias("long"), F.count_if(F.col("duration_type") == "short").alias("short"), F.sum("days").alias("days"), F.min("start").alias("first"))


#: What the models of segments are given.
FEATURES = ["ma4_slope", "ma20_slope", "ma47_slope", "ma4_ma47_ratio", "price_ma20_ratio", "price_change", "bullish_strength", "trend_consistency"]


def _predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The segments with their part, and a prediction for each of their bars: whether the close rises over five bars, by a model for each stage and duration type, fitted on the training part."""
    sums = _sums(spark, sf_dir)
    segments = learning.split(stages.stage_segments(sums).select("code", "stage", "lo", "hi", "start", "end", "duration_type"), "code", "stage", "lo")
    later = sums.select("code", F.col("n").alias("at"), F.lead("close", 5).over(by_time()).alias("later"))
    rows = learning.segment_rows(segments, sums).withColumn("at", F.col("n")).join(later, ["code", "at"])
    rows = rows.withColumn("label", (F.col("later") > F.col("close")).cast("int"))
    models = learning.fitted(rows.where("part = 'train'"), FEATURES, "label", "stage", "duration_type")
    return segments, learning.predicted(rows, FEATURES, models, "stage", "duration_type")


@_query
def segments_with_probabilities(spark, sf_dir):
    """Segments with the mean probabilities of their bars, where they are of the test part; the others have an empty map."""
    segments, rows = _predictions(spark, sf_dir)
    told = rows.where("part = 'test'").groupBy("code", "stage", "lo", "hi").agg(F.create_map(F.lit("class1"), 1 - F.avg("up"), F.lit("class2"), F.avg("up")).alias("probabilities"))
    return verdicts.with_probabilities(segments, told).select("code", "stage", "lo", "hi", "duration_type", F.size("probabilities").alias("classes"), F.round(F.coalesce(F.try_element_at("probabilities", F.lit("class2")), F.lit(0.0)), 4).alias("class2"))


@_query
def segment_votes(spark, sf_dir):
    """What the bars of each segment vote by their model's predictions, and the mean of both classes."""
    _, rows = _predictions(spark, sf_dir)
    told = rows.withColumn("probabilities", F.create_map(F.lit("up"), F.col("up"), F.lit("down"), 1 - F.col("up")))
    return learning.vote(told, "code", "stage", "lo", "hi").select("code", "stage", "lo", "hi", "kind", F.round(F.element_at("probabilities", "up"), 4).alias("up"), F.round(F.element_at("probabilities", "down"), 4).alias("down"))


TREE = ("div", ("sub", "ma4", "ma47"), ("max", "ma4_std", ("add", ("abs", "ma20_slope"), 1.0)))


@_query
def tree_features(spark, sf_dir):
    """A given expression tree over the last-bar features, and the part of the split that each code is in."""
    rows = learning.split(screen.last_bar_features(_sums(spark, sf_dir)), "code")
    return rows.select("code", F.round(learning.expression(TREE), 4).alias("value"), "part")


def _ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every bar that has five bars behind it, `ahead`, the change of the close up to the fifth, and the part of the split that it is in."""
    sums = _sums(spark, sf_dir)
    later = sums.select("code", "ts", (F.lead("close", 5).over(by_time()) / F.nullif("close", F.lit(0)) - 1).alias("ahead"))
    return learning.split(screen.bar_features(sums).join(later, ["code", "ts"]).where("ahead is not null"), "code", "ts")


#: The first generation of the scored trees, by its seed.
POPULATION = symbolic.first(random.Random(7), FEATURES, list(symbolic.FUNCTIONS), 40, 3)


@_query
def symbolic_fitness(spark, sf_dir):
    """How far each tree of a first generation goes with the next five bars' change, over the training part."""
    rows = _ahead(spark, sf_dir).where("part = 'train'")
    found = symbolic.fitness(symbolic.numbers(rows, FEATURES, "ahead"), POPULATION)
    return spark.createDataFrame([(i, learning.readable(t), round(r, 6)) for i, (t, r) in enumerate(zip(POPULATION, found, strict=True))], "place int, feature string, fitness double")


@_query
def symbolic_features(spark, sf_dir):
    """Features bred from the training part, with the size of their correlation there and in the test part."""
    rows = cut(_ahead(spark, sf_dir).select(*FEATURES, "ahead", "part"))
    found = symbolic.search(rows.where("part = 'train'"), FEATURES, "ahead", generations=4, population=100, components=5, hall=30, tournament=10)
    held = symbolic.fitness(symbolic.numbers(rows.where("part = 'test'"), FEATURES, "ahead"), [t for t, _ in found])
    return spark.createDataFrame([(i, learning.readable(t), symbolic.size(t), r, h) for i, ((t, r), h) in enumerate(zip(found, held, strict=True), 1)], "rank int, feature string, nodes int, fitness double, held_out double")


@_query
def tumbling_windows(spark, sf_dir):
    return screen.tumbling(_sums(spark, sf_dir))


@_query
def tail_bars(spark, sf_dir):
    return patterns.tail(_sums(spark, sf_dir)).select("code", "ts", "i", "close")


@_query
def last_bar_features(spark, sf_dir):
    return screen.last_bar_features(_sums(spark, sf_dir))


@_query
def stage_last_bars(spark, sf_dir):
    """Last-bar features of each code's bars in stage 2 alone."""
    sums = _sums(spark, sf_dir)
    held = stages.bars_of(stages.stage_positions(sums).where("stage = 'stage2'").select("code", "lo", "hi").distinct(), sums.select("code", "n")).select("code", "n", F.lit(2).alias("stage")).distinct()
    return screen.last_bar_features(sums.join(held, ["code", "n"]).where("stage = 2").drop("stage"))


@_query
def event_hours(spark, sf_dir):
    from barline.streaming.bars import hourly

    return hourly(sources.table(spark, sf_dir, "events")).select("code", F.col("ts").cast("timestamp_ntz").alias("ts"), "events", F.round("total", 4).alias("total"))


@_query
def indicator_bars(spark, sf_dir):
    """Recursive averages, running volume and streaks of every bar."""
    found = indicators.indicators(sources.walk(spark, sf_dir))
    return found.select("code", "ts", *[F.round(c, 4).alias(c) for c in ("rsi_7", "rsi_14", "kdj_k", "kdj_d", "kdj_j", "atr_ratio")], "obv", "up_streak", "down_streak", "current_trend_duration")


@_query
def model_features(spark, sf_dir):
    """Each code's last bar with every feature that a model's list names; what its history is too short for is 0."""
    found = indicators.indicators(sources.walk(spark, sf_dir))
    last = found.withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n")))).where("_r = 1")
    rows = screen.conform(last, list(indicators.NAMES))
    return rows.select("code", *[F.round(c, 3).alias(c) for c in indicators.NAMES])


@_query
def tick_sums(spark, sf_dir):
    """Averages over ticks, in blocks."""
    return blocks.rolling_sums(sources.ticks(spark, sf_dir)).select("code", "event_id", "n", *[f"s{k}" for k in PERIODS])


@_query
def tick_stages(spark, sf_dir):
    return blocks.stage_positions(sources.ticks(spark, sf_dir), order=("ts", "event_id"))


@_query
def tick_bullish_runs(spark, sf_dir):
    return blocks.bullish_runs(sources.ticks(spark, sf_dir), order=("ts", "event_id"))


@_query
def box_suppression(spark, sf_dir):
    """Boxes of unlike sizes, made from orders: keys are priorities."""
    rows = sources.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), (F.col("o_orderkey") % 97).alias("x1"), (F.col("o_custkey") % 89).alias("y1"), (F.col("o_orderkey") % 97 + 10 + F.col("o_orderkey") % 13).alias("x2"), (F.col("o_custkey") % 89 + 12).alias("y2"), F.col("o_totalprice").alias("score"))
    return screen.non_max_suppression(rows, "key")
