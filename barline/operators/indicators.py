"""Technical indicators of every bar, under the names of the models' feature lists.

All look back by a bounded number of bars, in blocks with the bars around them, but for running volume and streaks, which blocks carry on.
A recursive average y = d * y_before + (1 - d) * x forgets: what lies more than log(1e-20) / log(d) bars back is below a double's last digit. So a
block with that many bars before it has the whole average, as one running sum of x / d ** i, for i the place in the block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.ma import PERIODS
from barline.operators import blocks
from barline.operators.blocks import in_block

BLOCK = 512
_FORGOTTEN = math.log(1e20)

_SPANS, _LAGS = (3, 5, 10), (1, 2, 3)
_PAIRS = [(p, q) for p in (4, 8, 12) for q in (16, 20, 47)]
#: The names of the six lists together, in the order of the longest.
NAMES = (
    "close", "open", "high", "low", "price_range", "price_change", "price_change_ratio",
    *[f"close_{what}_{k}" for k in _SPANS for what in ("mean", "std", "maxmin", "range_ratio")],
    *[name for p in (4, 8, 12) for name in (f"MA{p}", f"MA{p}_slope", *[f"MA{p}_MA{q}_{what}" for q in (16, 20, 47) for what in ("ratio", "diff")])],
    *[name for p in (16, 20, 47) for name in (f"MA{p}", f"MA{p}_slope")],
    "rsi_14", "rsi_7", "kdj_k", "kdj_d", "kdj_j", "atr", "atr_ratio", "bollinger_upper", "bollinger_mid", "bollinger_lower", "bollinger_width", "obv", "obv_ratio", "wvad",
    *[f"{c}_lag{what}_{k}" for k in _LAGS for c in ("close", "vol") for what in ("", "_ratio")],
    "close_diff_1", "close_diff_2", "up_streak", "down_streak", "current_trend_duration", "macd", "macd_signal", "macd_hist",
)


def memory(decay: float) -> int:
    """How many bars a recursive average remembers."""
    return math.ceil(_FORGOTTEN / -math.log(decay))


def smoothed(x: Column, decay: float, place: Column, first: int = 0, start: float | None = None) -> Column:
    """The recursive average of x, a window expression over blocks that have memory(decay) bars before them; `place` is the bar's place in the block.

    The bar `first` of the series begins it: with its own x, or with `start` as the average before it. Earlier bars have no weight.
    """
    fresh = F.lit(1.0) * x if start is None else (1 - decay) * x + decay * start
    part = F.when(F.col("n") > first, (1 - decay) * x).when(F.col("n") == first, fresh).otherwise(0.0)
    total = F.sum(part * F.pow(F.lit(1 / decay), place)).over(in_block().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.col("n") >= first, total * F.pow(F.lit(decay), place))


def _span(k: int):  # noqa: ANN202
    return in_block().rowsBetween(1 - k, 0)


def _whole(c: Column, k: int) -> Column:
    """c where the series has k bars."""
    return F.when(F.col("n") >= k - 1, c)


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def indicators(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """bars (code, ts, open, high, low, close, vol) with n (from 0) and the columns NAMES.

    Means, deviations (of samples) and ranges are of closes; slopes are steps of an average. rsi: Wilder's averages of gains and losses, 50 without
    either; kdj: 9 bars, thirds, from 50; atr: Wilder's average of 14 true ranges; bollinger: 20 bars, two deviations (of the whole), width as a share of the
    middle; macd: 12, 26 and 9 bars, hist the difference; obv_ratio: of the volume so far; wvad: 24 bars. Null where the series is too short or a divisor is 0.
    """
    lag = lambda c, k=1: F.lag(c, k).over(in_block())
    back = max(memory(13 / 14), memory(25 / 27) + memory(8 / 10), 2 * memory(2 / 3))  # an average of averages remembers as long as both together
    if (block + back) * math.log(1.5) > 690:
        raise ValueError("powers over such blocks pass a double's range")
    rows = blocks.around(blocks.numbered(bars.select("code", "ts", "open", "high", "low", "close", "vol"), block=block), back, 0, block)
    place = F.col("n") - F.greatest(F.col("block") * block - back, F.lit(0))
    rows = rows.withColumns({"_place": place, "_step": F.col("close") - lag("close"), "_low9": F.min("low").over(_span(9)), "_high9": F.max("high").over(_span(9))})
    at = F.col("_place")
    gain, loss = F.greatest(F.col("_step"), F.lit(0)), F.greatest(-F.col("_step"), F.lit(0))
    reach = F.greatest(F.col("high"), F.coalesce(lag("close"), F.col("high"))) - F.least(F.col("low"), F.coalesce(lag("close"), F.col("low")))
    rsv = F.coalesce(_ratio((F.col("close") - F.col("_low9")) * 100.0, F.col("_high9") - F.col("_low9")), F.lit(50.0))
    mean = F.avg("close").over(_span(20))
    rows = rows.withColumns({
        **{f"_{name}{k}": smoothed(F.coalesce(x, F.lit(0)), 1 - 1 / k, at, first=1) for k in (7, 14) for name, x in (("gain", gain), ("loss", loss))},
        "atr": smoothed(reach, 13 / 14, at), "kdj_k": smoothed(rsv, 2 / 3, at, start=50.0),
        "macd": smoothed(F.col("close"), 11 / 13, at) - smoothed(F.col("close"), 25 / 27, at),
        **{f"MA{k}": _whole(F.avg("close").over(_span(k)), k) for k in PERIODS},
        "bollinger_mid": _whole(mean, 20), "_dev": _whole(F.stddev_pop("close").over(_span(20)), 20),
        "wvad": _whole(F.sum(F.coalesce(_ratio((F.col("close") - F.col("open")) * F.col("vol") * 1.0, F.col("high") - F.col("low")), F.lit(0.0))).over(_span(24)), 24),
    })
    rows = rows.withColumns({"kdj_d": smoothed(F.col("kdj_k"), 2 / 3, at, start=50.0), "macd_signal": smoothed(F.col("macd"), 8 / 10, at)})
    out: dict[str, Column] = {"price_range": F.col("high") - F.col("low"), "price_change": F.col("close") - F.col("open"), "price_change_ratio": _ratio((F.col("close") - F.col("open")) * 1.0, F.col("open"))}
    for k in _SPANS:
        width = F.max("close").over(_span(k)) - F.min("close").over(_span(k))
        out |= {f"close_mean_{k}": _whole(F.avg("close").over(_span(k)), k), f"close_std_{k}": _whole(F.stddev_samp("close").over(_span(k)), k), f"close_maxmin_{k}": _whole(width, k), f"close_range_ratio_{k}": _whole(_ratio(width * 1.0, F.avg("close").over(_span(k))), k)}
    out |= {f"MA{k}_slope": F.col(f"MA{k}") - lag(f"MA{k}") for k in PERIODS}
    for p, q in _PAIRS:
        out |= {f"MA{p}_MA{q}_ratio": _ratio(F.col(f"MA{p}"), F.col(f"MA{q}")), f"MA{p}_MA{q}_diff": F.col(f"MA{p}") - F.col(f"MA{q}")}
    for k in _LAGS:
        out |= {f"{c}_lag_{k}": lag(c, k) for c in ("close", "vol")} | {f"{c}_lag_ratio_{k}": _ratio(F.col(c) * 1.0, lag(c, k)) for c in ("close", "vol")}
    out |= {f"close_diff_{k}": F.col("close") - lag("close", k) for k in (1, 2)}
    strength = lambda k: F.when(F.col("n") >= 1, F.coalesce(_ratio(100 * F.col(f"_gain{k}"), F.col(f"_gain{k}") + F.col(f"_loss{k}")), F.lit(50.0)))
    out |= {"rsi_7": strength(7), "rsi_14": strength(14), "kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d"), "atr_ratio": _ratio(F.col("atr"), F.col("close")), "macd_hist": F.col("macd") - F.col("macd_signal")}
    out |= {"bollinger_upper": F.col("bollinger_mid") + 2 * F.col("_dev"), "bollinger_lower": F.col("bollinger_mid") - 2 * F.col("_dev"), "bollinger_width": _ratio(4 * F.col("_dev"), F.col("bollinger_mid"))}
    rows = rows.withColumns(out).where("own")
    rise, fall = F.coalesce(F.col("_step") > 0, F.lit(False)), F.coalesce(F.col("_step") < 0, F.lit(False))
    signed = F.coalesce(F.signum("_step").cast("long"), F.lit(0)) * F.col("vol")
    rows = carried(rows, {"obv": signed, "_volume": F.col("vol")}, {"_no_rise": ~rise, "_no_fall": ~fall})
    rows = rows.withColumns({"obv_ratio": _ratio(F.col("obv") * 1.0, F.col("_volume")), "up_streak": (F.col("n") - F.col("_no_rise")).cast("int"), "down_streak": (F.col("n") - F.col("_no_fall")).cast("int")})
    rows = rows.withColumn("current_trend_duration", F.greatest("up_streak", "down_streak"))
    return rows.select("code", "ts", "n", "vol", *NAMES)


def carried(rows: DataFrame, totals: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """rows (code, block, n) with running totals up to each bar, and the number of the last bar up to it that meets a condition.

    Blocks are added up by themselves; one row a block is passed along the code.
    """
    rows = rows.withColumns({**{f"_x{k}": v for k, v in totals.items()}, **{f"_x{k}": F.when(v, F.col("n")) for k, v in lasts.items()}})
    fold = {**dict.fromkeys(totals, F.sum), **dict.fromkeys(lasts, F.max)}
    before = Window.partitionBy("code").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("code", "block").agg(*[f(f"_x{k}").alias(f"_x{k}") for k, f in fold.items()])
    ends = ends.select("code", "block", *[f(f"_x{k}").over(before).alias(f"_c{k}") for k, f in fold.items()])
    up_to = in_block().rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({k: f(f"_x{k}").over(up_to) for k, f in fold.items()}).join(ends, ["code", "block"])
    both = {k: F.col(k) + F.coalesce(F.col(f"_c{k}"), F.lit(0)) for k in totals} | {k: F.coalesce(k, f"_c{k}") for k in lasts}
    return found.withColumns(both).drop(*[f"_{x}{k}" for x in "xc" for k in fold])
