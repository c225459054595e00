"""Recent screens, windows of fixed length, last-bar features, and small geometry."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.ma import by_time, PERIODS, above, average, ordered, s
from barline.operators.patterns import tail
from barline.sources.store import cut


def recent_windows(sums: DataFrame, days: int = 20, least: int = 3, stage: int | tuple[int, ...] = 2) -> DataFrame:
    """Maximal windows inside the last bars: code, lo, hi (bars from 0), start, end; with several stages also `stage`, found in one pass.

    stage 2: bullish arrangement on every bar, and each average up in 60 % of the steps and over the window. stage 1: at least 3 averages
    up in half of the steps and over the window, at least two bars with an upward cross, and averages that spread by a fifth.
    Prefix sums make each window's test a difference of two rows; there are at most days * days / 2 windows a code, whatever its
    history. Windows inside another one leave.
    """
    wanted = (stage,) if isinstance(stage, int) else stage
    found = tested_windows(sums, days, least).select("code", "lo", "hi", "start", "end", F.explode(F.array(*[F.when(F.col(f"stage{k}"), F.lit(k)) for k in wanted])).alias("stage")).where("stage is not null")
    found = maximal(found, "code", "stage")
    return found.drop("stage") if isinstance(stage, int) else found


def tested_windows(sums: DataFrame, days: int, least: int) -> DataFrame:
    """Every window of `least` bars or more in the last bars with both tests (stage2, stage1), whether MA4 falls below MA20 in its last two bars (fell), and whether MA4 is below its value before on the last bar (lower)."""
    w = Window.partitionBy("code").orderBy("i")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = tail(sums, days, whole=True)
    false = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c: F.sum(false(c).cast("int")).over(up_to)
    crossed = reduce(lambda a, b: a | b, [(F.lag(above(q, p)).over(w)) & above(p, q) for a, p in enumerate(PERIODS) for q in PERIODS[a + 1 :]])
    mean = sum((average(k) for k in PERIODS), F.lit(0.0)) / 6
    fell = false(F.lag(above(4, 20)).over(w) & above(20, 4))
    rows = rows.withColumns({**{f"u{k}": count(s(k) > F.lag(s(k)).over(w)) for k in PERIODS}, "bad": count(~ordered()), "crosses": count(crossed), "own_bad": (~ordered()).cast("int"), "mean": mean, "fell": fell, "lower": false(s(4) < F.lag(s(4)).over(w))})
    rows = rows.withColumn("fell", F.col("fell") | false(F.lag("fell").over(w)))
    rows = rows.withColumn("spread", F.sqrt(sum(((average(k) - F.col("mean")) * (average(k) - F.col("mean")) for k in PERIODS), F.lit(0.0)) / 5))
    a, b = rows.alias("a"), rows.alias("b")
    size = F.col("b.i") - F.col("a.i")
    pairs = a.join(b, (F.col("a.code") == F.col("b.code")) & (size >= least - 1))
    risen = lambda k, share: ((F.col(f"b.u{k}") - F.col(f"a.u{k}")) >= share * size) & (F.col(f"b.s{k}") > F.col(f"a.s{k}"))
    two = (F.col("b.bad") - F.col("a.bad") + F.col("a.own_bad") == 0) & reduce(lambda x, y: x & y, [risen(k, 0.6) for k in PERIODS])
    # The first bar's own cross needs the bar before the window, so it doesn't count.
    one = (sum((risen(k, 0.5).cast("int") for k in PERIODS), F.lit(0)) >= 3) & (F.col("b.crosses") - F.col("a.crosses") >= 2) & (F.col("b.spread") > 1.2 * F.col("a.spread"))
    columns = [F.col("a.code").alias("code"), F.col("a.i").alias("lo"), F.col("b.i").alias("hi"), F.col("a.ts").alias("start"), F.col("b.ts").alias("end")]
    return pairs.select(*columns, two.alias("stage2"), one.alias("stage1"), F.col("b.fell").alias("fell"), F.col("b.lower").alias("lower"))


def maximal(windows: DataFrame, *keys: str) -> DataFrame:
    """Windows (code, lo, hi) that no other one with the same keys contains."""
    w = Window.partitionBy(*(keys or ("code",))).orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("hi").over(w)
    return windows.withColumn("_reached", reached).where(F.col("_reached").isNull() | (F.col("hi") > F.col("_reached"))).drop("_reached")


def latest(windows: DataFrame) -> DataFrame:
    """The window of each code that ends last; of equals the longest."""
    w = Window.partitionBy("code").orderBy(F.desc("hi"), "lo")
    return windows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def current_stage(sums: DataFrame, days: int = 30, least: int = 3, lookback: int | None = None) -> DataFrame:
    """The stage that each code is in: code, lo, hi, start, end, stage; codes in none leave. Stage 2 is looked for in the last `days` bars, stage 1 in the last `lookback`, by default as many.

    Of the maximal windows, stage 2 counts if MA4 doesn't fall below MA20 in its last two bars, and it holds the series' last bar, where MA4 is not below its value before.
    Without one, stage 1 counts under the first of these conditions. Of several the latest counts.
    """
    lookback = days if lookback is None else lookback
    tested = tested_windows(sums, days, least)
    if lookback != days:
        one = tested_windows(sums, lookback, least).withColumn("stage2", F.lit(False))
        tested = tested.withColumn("stage1", F.lit(False)).unionByName(one)
    both = tested.withColumn("stage", F.explode(F.array(*[F.when(F.col(f"stage{k}"), F.lit(f"stage{k}")) for k in (2, 1)]))).where("stage is not null").drop("stage1", "stage2")
    kept = maximal(both, "code", "stage").where(~F.col("fell") & ((F.col("stage") == "stage1") | ((F.col("hi") == days - 1) & ~F.col("lower"))))
    order = Window.partitionBy("code").orderBy(F.desc("stage"), F.desc("hi"), "lo")
    return kept.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("code", "lo", "hi", "start", "end", "stage")


def tumbling(sums: DataFrame, size: int = 21, offsets: tuple[int, ...] = (0, 10)) -> DataFrame:
    """Windows of `size` bars one after another, from each offset: phase, k, start, end, bullish (arranged throughout, and each average ends higher)."""
    phased = sums.withColumn("phase", F.explode(F.array(*map(F.lit, offsets)))).where(F.col("n") >= F.col("phase"))
    phased = phased.withColumn("k", F.floor((F.col("n") - F.col("phase")) / size).cast("int"))
    higher = reduce(lambda a, b: a & b, [F.max_by(f"s{k}", "n") > F.min_by(f"s{k}", "n") for k in PERIODS])
    return phased.groupBy("code", "phase", "k").agg(F.count("*").alias("bars"), F.min("ts").alias("start"), F.max("ts").alias("end"), (F.bool_and(ordered()) & higher).alias("bullish")).where(F.col("bars") == size).drop("bars")


#: Names of the features that take more than 10 bars, and of those that take more than 5.
_LONG = re.compile(r"_alignment$|^ma\d+_ma47_(ratio|diff)$|_slope$|_direction_change$|_acceleration$")
_SHORT = re.compile(r"^price_(ma|above|cross)|_volume_(up|down)$|_std|_spread|_strength$|^trend_consistency$")


def last_bar_features(sums: DataFrame) -> DataFrame:
    """bar_features of each code's last bar."""
    found = bar_features(sums)
    last = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("ts")))
    return found.withColumn("_r", last).where("_r = 1").drop("_r", "ts")


def bar_features(sums: DataFrame) -> DataFrame:
    """code, ts and features of every bar, of it and the code's bars before it; where these are too few they are 0.

    Levels, slopes, turns and arrangements take more than 10 bars; what compares the close or the volume with others, deviations and strengths more than 5.
    trend_consistency is the larger of bullish and bearish strength. Equal closes or volumes are neither up nor down.
    """
    back = lambda c, n: F.lag(c, n).over(by_time())
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = {"close": F.col("close"), "vol": F.col("vol"), "bullish_alignment": ordered().cast("int"), "bearish_alignment": ordered(PERIODS[::-1]).cast("int")}
    for k in PERIODS:
        out[f"ma{k}"] = F.round(average(k), 6)
        out[f"ma{k}_slope"] = F.round(ratio(s(k), back(s(k), 4)) - F.when(back(s(k), 4).isNull(), 0).otherwise(1), 6)
    for k in (4, 8, 20):
        out[f"ma{k}_ma47_ratio"] = F.round(ratio(average(k), average(47)), 6)
        out[f"ma{k}_ma47_diff"] = F.round(average(k) - average(47), 6)
        out[f"ma{k}_std"] = F.round(F.coalesce(F.stddev_samp(average(k)).over(by_time().rowsBetween(-4, 0)), F.lit(0.0)), 4)
    for k in (4, 8, 20, 47):
        out[f"price_ma{k}_ratio"] = F.round(ratio(F.col("close") * k, s(k)), 6)
        out[f"price_above_ma{k}"] = (F.col("close") * k > s(k)).cast("int")
    for k in (4, 20):
        out[f"price_cross_ma{k}"] = F.coalesce((back(F.col("close") * k <= s(k), 1)) & (F.col("close") * k > s(k)), F.lit(False)).cast("int")
        out[f"ma{k}_acceleration"] = F.round(F.coalesce((s(k) - 2 * back(s(k), 1) + back(s(k), 2)) / k, F.lit(0.0)), 6)
    up, down, more, less = F.col("close") > back("close", 1), F.col("close") < back("close", 1), F.col("vol") > back("vol", 1), F.col("vol") < back("vol", 1)
    false = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out |= {"price_up_volume_down": false(up & less), "price_down_volume_down": false(down & less), "price_change": F.round(ratio(F.col("close"), back("close", 1)) - F.when(back("close", 1).isNull(), 0).otherwise(1), 6), "volume_change": F.round(ratio(F.col("vol"), back("vol", 1)) - F.when(back("vol", 1).isNull(), 0).otherwise(1), 6)}
    for k in (4, 20):
        turn = (s(k) > back(s(k), 1)) & (back(s(k), 1) < back(s(k), 2))
        out[f"ma{k}_direction_change"] = false(turn)
    out |= {"ma_up_volume_up": false((s(20) > back(s(20), 1)) & more), "ma_down_volume_up": false((s(20) < back(s(20), 1)) & more)}
    spread = lambda n: F.abs(s(4) * 5 - s(20)) if not n else F.abs(back(s(4) * 5 - s(20), n))
    deviation = lambda k: F.stddev_samp(s(k)).over(by_time().rowsBetween(-4, 0))
    out |= {"ma4_ma20_spread": F.round(spread(0) / 20, 6), "ma4_ma20_spread_change": F.round(ratio(spread(0), spread(1)) - F.when(F.coalesce(spread(1), F.lit(0)) == 0, 0).otherwise(1), 6)}
    out["ma4_ma20_std_ratio"] = F.round(F.coalesce(F.when(deviation(20) > 0, deviation(4) * 5 / deviation(20)), F.lit(0.0)), 4)
    side = lambda a, b: above(a, b).cast("int")
    pairs = list(zip(PERIODS, PERIODS[1:], strict=False))
    out |= {"bullish_strength": sum((side(p, q) for p, q in pairs), F.lit(0)) / 5, "bearish_strength": sum((side(q, p) for p, q in pairs), F.lit(0)) / 5}
    out |= {f"{name}_std_5": F.round(F.coalesce(F.stddev_samp(c).over(by_time().rowsBetween(-4, 0)), F.lit(0.0)), 4) for name, c in (("price", "close"), ("volume", "vol"))}
    out["trend_consistency"] = F.greatest(out["bullish_strength"], out["bearish_strength"])
    if "open" in sums.columns:
        out |= {c: F.col(c) for c in ("open", "high", "low")}
    rows = sums.select("code", "ts", *[c.alias(k) for k, c in out.items()], F.row_number().over(by_time()).alias("_bars"))
    least = {k: 10 if _LONG.search(k) else 5 if _SHORT.search(k) else 0 for k in out}
    return rows.select("code", "ts", *[(F.when(F.col("_bars") > least[k], F.col(k)).otherwise(0) if least[k] else F.col(k)).alias(k) for k in out])


def conform(features: DataFrame, names: list[str], key: str = "code") -> DataFrame:
    """The features in the order of a model's list; missing ones are 0, others leave."""
    return features.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in features.columns else F.lit(0.0).alias(c) for c in names])


def _overlap(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Intersection over union of two boxes; areas count the last pixel."""
    area = lambda x: (x("x2") - x("x1") + 1) * (x("y2") - x("y1") + 1)
    side = lambda lo, hi: F.greatest(F.least(a(hi), b(hi)) - F.greatest(a(lo), b(lo)) + 1, F.lit(0.0))
    both = side("x1", "x2") * side("y1", "y2")
    return both / (area(a) + area(b) - both)


def _suppress(table: pa.Table, threshold: float) -> pa.Table:
    """The kept boxes of one key, of few boxes, by a loop."""
    table = table.sort_by("place")
    boxes = {c: table[c].to_numpy() for c in ("x1", "y1", "x2", "y2")}
    area = (boxes["x2"] - boxes["x1"] + 1) * (boxes["y2"] - boxes["y1"] + 1)
    left, kept = np.arange(len(area)), []
    while len(left):
        one = left[0]
        kept.append(one)
        side = lambda lo, hi: np.maximum(np.minimum(boxes[hi][one], boxes[hi][left]) - np.maximum(boxes[lo][one], boxes[lo][left]) + 1, 0)  # noqa: B023, E731
        both = side("x1", "x2") * side("y1", "y2")
        stay = both / (area[one] + area[left] - both) <= threshold
        stay[0] = False
        left = left[stay]
    return table.take(kept)


def non_max_suppression(boxes: DataFrame, key: str, threshold: float = 0.4, few: int = 20_000) -> DataFrame:
    """Boxes (x1, y1, x2, y2, score) of each key that no better kept box overlaps by more than the threshold (from 0 to below 1); areas count the last pixel.

    Equal boxes are one. Boxes lie in grids by size, one for each power of two of the width and of the height, with cells of a
    quarter of that size. In each round the best undecided box of a cell is kept if the best boxes of all cells within reach are
    not better, and drops what it overlaps; so the rows of a round grow with the undecided boxes, never with their pairs. As soon as no more than `few` are undecided,
    a loop over each key decides them. Boxes without area, or with a null or unbounded coordinate, overlap nothing and stay.
    """
    if not 0 <= threshold < 1:
        raise ValueError("the threshold is from 0 to below 1")
    names = ["x1", "y1", "x2", "y2"]
    rows = boxes.select(F.struct(F.col(key)).alias("key"), *[F.col(c).cast("double").alias(c) for c in names], F.struct((-F.col("score")).alias("order"), F.col("score").cast("double").alias("score")).alias("best"))
    flat = F.lit(True)
    for c in names:
        flat = flat & F.col(c).isNotNull() & (F.abs(c) < 1e15)
    flat = F.coalesce(flat & (F.col("x2") - F.col("x1") + 1 > 0) & (F.col("y2") - F.col("y1") + 1 > 0), F.lit(False))
    out = lambda df: df.select(F.col("key")[key].alias(key), *names, "best.score")
    level = lambda lo, hi: F.floor(F.log2(F.col(hi) - F.col(lo) + 1)).cast("int")
    cell = lambda c, at: F.floor(c / (F.pow(F.lit(2.0), at) / 4))
    left = rows.where(flat).groupBy("key", *names).agg(F.min("best").alias("best"))
    left = left.withColumns({"lx": level("x1", "x2"), "ly": level("y1", "y2"), "rank": F.struct("best", *names)})
    left = cut(left.withColumns({"cx": cell(F.col("x1"), F.col("lx")), "cy": cell(F.col("y1"), F.col("ly"))}))
    # Pairs of sizes that can overlap enough; their number is bounded by the range of sizes. A box can't begin further behind
    # another one's beginning than this share of the other one's size.
    share = (1 - threshold) * (1 + 1e-9)
    sizes = left.groupBy("lx", "ly").agg((share * F.max(F.col("x2") - F.col("x1") + 1)).alias("wide"), (share * F.max(F.col("y2") - F.col("y1") + 1)).alias("high"))
    close = lambda a, b: F.pow(F.lit(2.0), F.greatest(a, b)) * threshold < F.pow(F.lit(2.0), F.least(a, b) + 1)
    meets = sizes.crossJoin(sizes.select(F.col("lx").alias("mx"), F.col("ly").alias("my"), F.col("wide").alias("mwide"), F.col("high").alias("mhigh"))).where(close(F.col("lx"), F.col("mx")) & close(F.col("ly"), F.col("my")))
    meets = F.broadcast(cut(meets))
    place, near = ["key", "lx", "ly", "cx", "cy"], ["key", "mx", "my", "nx", "ny"]

    def spread(df: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], *more: str) -> DataFrame:
        """df for each cell of each size whose boxes can begin within reach of one that begins between x[0] and y[0], and reaches to x[1] and y[1]."""
        df = df.join(meets, ["lx", "ly"])
        for new, (lo, hi), m, size in (("nx", x, "mx", "mwide"), ("ny", y, "my", "mhigh")):
            df = df.withColumn(new, F.explode(F.sequence(cell(lo - F.col(size), F.col(m)), cell(hi, F.col(m)))))
        return df.select(*near, *more)

    kept = []
    while left.count() > few:
        best = cut(left.groupBy(*place).agg(F.min("rank").alias("rank")))
        edge = lambda c, at, size: (F.col(c) * F.pow(F.lit(2.0), F.col(at)) / 4, (F.col(c) + 1) * F.pow(F.lit(2.0), F.col(at)) / 4 + F.col(size))
        around = spread(best, edge("cx", "lx", "wide"), edge("cy", "ly", "high"), "rank").groupBy(*near).agg(F.min("rank").alias("least"))
        around = around.select("least", *[F.col(n).alias(p) for n, p in zip(near, place, strict=True)])
        won = best.join(around, place).where(F.col("rank") == F.col("least")).select("key", "lx", "ly", F.col("rank.best").alias("best"), *[F.col("rank")[c].alias(c) for c in names])
        won = cut(won)
        kept.append(won)
        drop = spread(won, *[(F.col(lo), F.col(lo) + share * (F.col(hi) - F.col(lo) + 1)) for lo, hi in (("x1", "x2"), ("y1", "y2"))], *names)
        drop = drop.select(*[F.col(n).alias(f"_{p}") for n, p in zip(near, place, strict=True)], *[F.col(c).alias(f"_{c}") for c in names])
        hit = reduce(lambda a, b: a & b, [F.col(p) == F.col(f"_{p}") for p in place]) & (_overlap(F.col, lambda c: F.col(f"_{c}")) > threshold)
        left = cut(left.join(drop, hit, "left_anti"))
    kept.append(left.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("rank"))).drop("rank"))
    kept[-1] = kept[-1].groupBy("key").applyInArrow(lambda t: _suppress(t, threshold), kept[-1].schema)
    return reduce(DataFrame.unionByName, [out(x) for x in (rows.where(~flat), *kept)])
