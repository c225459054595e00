"""Series of any length, in blocks of bars: what a window over a whole code finds, without one task that holds it.

Bars are numbered by counts of time buckets. From then on a block is `block` bars of a code, one after another. What looks back or ahead by a bounded number of
bars is computed in blocks that also have the bars around them (`around`). What looks back or ahead without bound is carried:
each block tells its first and last events and its runs (`runs`), one row a block is passed along the code, and runs that cross an edge are joined.

Series of days fit a window by code; use this for series of ticks or minutes. Results are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.ma import PERIODS
from barline.operators import stages

BLOCK = 1 << 16


def in_block() -> WindowSpec:
    return Window.partitionBy("code", "block").orderBy("n")


def _back(by: str, *keys: str) -> WindowSpec:
    """From the last row to the first. What lies behind a row is read this way: a frame without a following bound is summed anew for each row, in time that grows with the square of the rows."""
    return Window.partitionBy("code", *keys).orderBy(F.desc(by))


def _bucket(bars: DataFrame, time: str) -> Column:
    """Years of days, days of timestamps: the resolution of the time bounds a bucket's bars."""
    return F.year(time) if isinstance(bars.schema[time].dataType, T.DateType) else F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date"))


def numbered(bars: DataFrame, totals: dict[str, Column] | None = None, order: tuple[str, ...] = ("ts",), block: int = BLOCK) -> DataFrame:
    """bars with n, the place in the code's order from 0, its block, and running totals up to each bar.

    `order` tells bars of a code apart; its first column is the time. Two passes over the bars: counts and sums of buckets, then places in them.
    """
    totals = totals or {}
    rows = bars.withColumns({"_bucket": _bucket(bars, order[0]), **{f"_{k}": v for k, v in totals.items()}})
    sizes = rows.groupBy("code", "_bucket").agg(F.count("*").alias("_n0"), *[F.sum(f"_{k}").alias(f"_{k}0") for k in totals])
    earlier = Window.partitionBy("code").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select("code", "_bucket", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n0", *[f"_{k}0" for k in totals])])
    inside = Window.partitionBy("code", "_bucket").orderBy(*order)
    found = rows.withColumns({"n": F.row_number().over(inside), **{k: F.sum(f"_{k}").over(inside) for k in totals}}).join(carried, ["code", "_bucket"])
    found = found.withColumns({"n": F.col("n") + F.col("_n0") - 1, **{k: F.col(k) + F.col(f"_{k}0") for k in totals}})
    return found.withColumn("block", F.expr(f"n div {block}")).drop("_bucket", "_n0", *[f"_{k}" for k in totals], *[f"_{k}0" for k in totals])


def around(rows: DataFrame, back: int, ahead: int = 0, block: int = BLOCK) -> DataFrame:
    """Each bar in its own block, and again in the blocks that look back up to `back` bars or ahead up to `ahead` bars to it; `own` tells which it is."""
    blocks = F.sequence(F.expr(f"greatest(n - {ahead}, 0) div {block}"), F.expr(f"(n + {back}) div {block}"))
    return rows.drop("block").withColumn("block", F.explode(blocks)).withColumn("own", F.expr(f"n div {block} = block"))


def rolling_sums(bars: DataFrame, periods: tuple[int, ...] = PERIODS, order: tuple[str, ...] = ("ts",), block: int = BLOCK, back: int = 0, ahead: int = 0) -> DataFrame:
    """As stages.rolling_sums, with `block`. With `back` or `ahead` so many bars around a block stay, too, with their sums; `own` is false for them.

    Bars that `numbered` has numbered by the same block aren't numbered again.
    """
    longest = max(periods)
    known = {"n", "block"} <= set(bars.columns)
    rows = around(bars if known else numbered(bars, order=order, block=block), longest - 1 + back, ahead, block)
    rows = rows.withColumns({f"s{k}": F.sum("close").over(in_block().rowsBetween(1 - k, 0)) for k in periods}).where(F.col("n") >= longest - 1)
    first = F.col("block") * block - back
    return rows.where(F.col("n") >= first).withColumn("n", F.col("n") - (longest - 1)) if back or ahead else rows.where("own").drop("own").withColumn("n", F.col("n") - (longest - 1))


def runs(rows: DataFrame, flag: Column, last_before: dict[str, Column], next_after: dict[str, Column], next_from: dict[str, Column], first: dict[str, Column], last: dict[str, Column]) -> DataFrame:
    """Maximal runs of bars with the flag: code, a, b (bar numbers), last_n (the code's last bar) and

    last_before: the last bar before a that meets a condition; next_after: the first one behind b; next_from: the first one at a or behind it;
    first, last: what a column has at a and at b. rows have code, block and n. Every block becomes one row, with its runs in a list, and
    only those rows are ordered by code.
    """
    number = F.col("n")
    start, back = Window.unboundedPreceding, _back("n", "block")
    earlier, later, on = in_block().rowsBetween(start, -1), back.rowsBetween(start, -1), back.rowsBetween(start, 0)
    conditions = {**last_before, **next_after, **next_from}
    marked = rows.select("code", "block", "n", flag.alias("_flag"), *[F.when(c, number).alias(f"_{k}") for k, c in conditions.items()], *[c.alias(k) for k, c in {**first, **last}.items()])
    marked = marked.withColumns({
        **{k: F.max(f"_{k}").over(earlier) for k in last_before}, **{k: F.min(f"_{k}").over(later) for k in next_after}, **{k: F.min(f"_{k}").over(on) for k in next_from},
        "_island": F.when(F.col("_flag"), number - F.count_if("_flag").over(in_block().rowsBetween(start, 0))),
    })
    at_a, at_b = (*last_before, *next_from, *first), (*next_after, *last)
    parts = marked.groupBy("code", "block", "_island").agg(
        F.min("n").alias("a"), F.max("n").alias("b"), *[F.min_by(k, "n").alias(k) for k in at_a], *[F.max_by(k, "n").alias(k) for k in at_b],
        *[(F.max if k in last_before else F.min)(f"_{k}").alias(f"_{k}") for k in conditions],
    )
    part = F.struct("a", "b", *at_a, *at_b)
    blocks = parts.groupBy("code", "block").agg(
        F.min("a").alias("_lo"), F.max("b").alias("_hi"), F.collect_list(F.when(F.col("_island").isNotNull(), part)).alias("_parts"),
        *[(F.max if k in last_before else F.min)(f"_{k}").alias(f"_{k}") for k in conditions],
    )
    # The start of the run that is open at a block's end, -1 if none is; a block that goes on with a run from its first to its last bar says nothing.
    along = Window.partitionBy("code").orderBy("block")
    blocks = blocks.withColumn("_tail", F.coalesce(F.try_element_at(F.filter("_parts", lambda p: p["b"] == F.col("_hi")), F.lit(1))["a"], F.lit(-1)))
    goes_on = (F.col("_tail") == F.col("_lo")) & F.coalesce(F.lag("_tail").over(along) >= 0, F.lit(False))
    blocks = blocks.withColumn("_opened", F.when(~goes_on, F.col("_tail")))
    before, behind = along.rowsBetween(start, -1), _back("block").rowsBetween(start, -1)
    blocks = blocks.withColumns({
        "_open": F.coalesce(F.last("_opened", ignorenulls=True).over(before), F.lit(-1)), "last_n": F.max("_hi").over(Window.partitionBy("code")),
        **{f"_c{k}": F.max(f"_{k}").over(before) if k in last_before else F.min(f"_{k}").over(behind) for k in conditions},
    })
    each = blocks.select("code", "last_n", "_open", "_lo", *[f"_c{k}" for k in conditions], F.inline("_parts"))
    carried = {k: F.coalesce(k, f"_c{k}") for k in conditions}
    opened = F.when((F.col("a") == F.col("_lo")) & (F.col("_open") >= 0), F.col("_open")).otherwise(F.col("a"))
    each = each.withColumns({**carried, "_start": opened})
    found = each.groupBy("code", "_start").agg(F.max("b").alias("b"), F.max("last_n").alias("last_n"), *[F.min_by(k, "a").alias(k) for k in at_a], *[F.max_by(k, "b").alias(k) for k in at_b])
    return found.withColumnRenamed("_start", "a")


def marked_bars(bars: DataFrame, periods: tuple[int, ...] = PERIODS, order: tuple[str, ...] = ("ts",), block: int = BLOCK) -> DataFrame:
    """The sums and flags of stages.flags, and `qualified`: MA4 alone drops on the next bar."""
    sums = rolling_sums(bars, periods, order, block, back=1, ahead=1)
    rows = stages.flags(sums, periods, in_block()).withColumn("qualified", F.coalesce(F.lead("only4").over(in_block()), F.lit(False)))
    return rows.where("own").drop("own")


def _needed(bars: DataFrame, order: tuple[str, ...]) -> DataFrame:
    return bars.select("code", *order, "close", *[c for c in ("n", "block") if {"n", "block"} <= set(bars.columns)])


def stage_positions(bars: DataFrame, periods: tuple[int, ...] = PERIODS, order: tuple[str, ...] = ("ts",), block: int = BLOCK) -> DataFrame:
    """stages.stage_positions of bars (code, the columns of `order`, close)."""
    rows = marked_bars(_needed(bars, order), periods, order, block)
    found = runs(rows, F.col("s2"), {"weak": (F.col("rc") < 4) & (F.col("n") >= 1)}, {"next3": F.col("joint")}, {"next5": F.col("p5")}, {}, {"qualified": F.col("qualified")})
    return stages.positions_of(found.withColumnRenamed("last_n", "last"))


def bullish_runs(bars: DataFrame, order: tuple[str, ...] = ("ts",), block: int = BLOCK) -> DataFrame:
    """stages.bullish_runs of bars (code, the columns of `order`, close)."""
    time = F.col(order[0])
    rows = marked_bars(_needed(bars, order), order=order, block=block)
    found = runs(rows, F.col("s2") | (F.col("ordered") & (F.col("n") == 0)), {}, {"next4": F.col("p4")}, {}, {"start": time}, {"end": time})
    return found.select("code", "start", "end", (F.col("b") - F.col("a") + 1).cast("int").alias("bars"), F.col("next4").isNull().alias("valid"))
