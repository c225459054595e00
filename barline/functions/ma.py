"""Expressions over rolling sums of closes in integer cents.

A bar has s4 .. s47, the sums of its last k closes. Averages are compared without division, so Spark and any other engine agree
exactly: MA_p > MA_q means q * s_p > p * s_q, and MA_k rises where s_k does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

PERIODS = (4, 8, 12, 16, 20, 47)


def by_time() -> WindowSpec:
    return Window.partitionBy("code").orderBy("ts")


def s(k: int) -> Column:
    return F.col(f"s{k}")


def above(p: int, q: int) -> Column:
    return s(p) * q > s(q) * p


def before(column: Column, n: int = 1, by: WindowSpec | None = None) -> Column:
    """The column n bars before. `by` is the window of a series' bars in order; series of days have by_time()."""
    return F.lag(column, n).over(by_time() if by is None else by)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def ordered(periods: tuple[int, ...] = PERIODS) -> Column:
    """Bullish arrangement: every average above the next longer one."""
    return all_of([above(p, q) for p, q in zip(periods, periods[1:], strict=False)])


def rises(k: int, by: WindowSpec | None = None) -> Column:
    """Strictly above its value one bar before; false on the first bar."""
    return F.coalesce(s(k) > before(s(k), by=by), F.lit(False))


def rising_count(periods: tuple[int, ...] = PERIODS, by: WindowSpec | None = None) -> Column:
    return reduce(lambda a, b: a + b, [rises(k, by).cast("int") for k in periods])


def golden_cross(short: int, long: int) -> Column:
    """Not above one bar before, above now."""
    return F.coalesce((before(s(short) * long) <= before(s(long) * short)) & above(short, long), F.lit(False))


def death_cross(short: int, long: int) -> Column:
    return F.coalesce((before(s(short) * long) >= before(s(long) * short)) & above(long, short), F.lit(False))


def falls_below(short: int, long: int, strict: bool = True, by: WindowSpec | None = None) -> Column:
    """Strictly above one bar before; now below, or with strict=False not above."""
    now = above(long, short) if strict else ~above(short, long)
    return F.coalesce(before(above(short, long), by=by) & now, F.lit(False))


def average(k: int) -> Column:
    return s(k) / F.lit(k)
