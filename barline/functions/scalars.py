"""Keys, dates and array similarities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stock_code(code: Column) -> Column:
    """Six characters, whatever suffix or lost zeros the input has."""
    return F.lpad(F.substring_index(code.cast("string"), ".", 1), 6, "0")


def suffixed(code: Column) -> Column:
    return F.concat(code, F.when(F.startswith(code, F.lit("6")), ".SH").otherwise(".SZ"))


def exchange_index(code: Column) -> Column:
    return F.when(F.startswith(code, F.lit("6")) | F.endswith(code, F.lit(".SH")), "000001").otherwise("399001")


def parse_date(text: Column) -> Column:
    """yyyyMMdd, yyyy-MM-dd, or a timestamp whose time is cut off; null otherwise."""
    return F.coalesce(F.try_to_date(text, "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def recent_days(text: Column, default: int = 20) -> Column:
    """The first number in a text such as 'last 30 days'."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(default))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return F.try_divide(total(values), F.size(values))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    dot = lambda x, y: total(F.zip_with(x, y, lambda u, v: u * v))
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def resample(values: Column, length: int | Column) -> Column:
    """Linear resampling of an array to a length; one value is repeated."""
    n = F.size(values)
    length = F.lit(length) if isinstance(length, int) else length

    def at(i: Column) -> Column:
        x = i * (n - 1) / F.greatest(length - 1, F.lit(1)).cast("double")
        low = F.least(F.floor(x).cast("int"), F.greatest(n - 2, F.lit(0)))
        a, b = F.get(values, low), F.coalesce(F.get(values, low + 1), F.get(values, low))
        return a + (b - a) * (x - low)

    return F.transform(F.sequence(F.lit(0), length - 1), at)


def unified(values: Column, other: Column) -> Column:
    """values, resampled to the length of the longer of both arrays; an empty array stays empty."""
    length = F.greatest(F.size(values), F.size(other))
    return F.when((F.size(values) == length) | (F.size(values) == 0), values).otherwise(resample(values, length))


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping distance, steps (1, 1) at double cost, for short arrays.

    The step pattern is an assumption about the usual default, called symmetric2: a diagonal step counts its cost twice.
    """
    far = F.lit(float("inf"))

    def row(state: Column, x: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            cost = F.abs(x - F.get(b, i))
            corner = F.when(i > 0, F.coalesce(F.get(state, i - 1), far)).otherwise(far) + 2 * cost
            up, left = F.coalesce(F.get(state, i), far) + cost, F.when(i > 0, F.get(acc, i - 1)).otherwise(far) + cost
            first = F.when((F.size(state) == 0) & (i == 0), cost).otherwise(far)
            return F.concat(acc, F.array(F.least(first, corner, up, left)))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array().cast("array<double>"), cell)

    return F.element_at(F.aggregate(a, F.array().cast("array<double>"), row), -1)
