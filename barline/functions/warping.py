"""Dynamic time warping of pairs of arrays, a batch at a time."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 20  # cells of a diagonal over all pairs that are worked on at once


def warp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distance of each row of a from the same row of b; a diagonal step counts its cost twice (see scalars.dtw). Diagonals of the table are filled one by one."""
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    older, old = (np.full((pairs, n + 1), np.inf) for _ in range(2))
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        cost = np.abs(a[:, lo : hi + 1] - b[:, d - hi : d - lo + 1][:, ::-1])
        new = np.full((pairs, n + 1), np.inf)
        best = np.minimum(np.minimum(old[:, lo : hi + 1], old[:, lo + 1 : hi + 2]) + cost, older[:, lo : hi + 1] + 2 * cost)
        new[:, lo + 1 : hi + 2] = best if d else cost
        older, old = old, new
    return old[:, n]


def warp_all(a: list, b: list) -> np.ndarray:
    """Distances of arrays of any lengths, those of one shape together; NaN where one is null or empty."""
    out = np.full(len(a), np.nan)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is not None and y is not None and len(x) and len(y):
            shapes.setdefault((len(x), len(y)), []).append(i)
    for (n, m), own in shapes.items():
        step = max(1, CELLS // max(n, m))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            out[part] = warp(np.stack([a[i] for i in part]).astype(float), np.stack([b[i] for i in part]).astype(float))
    return out


@cache
def _udf():  # noqa: ANN202
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        found = warp_all(list(a), list(b))
        return pd.Series([None if np.isnan(x) else x for x in found], dtype="Float64")

    return run


def distance(a: str, b: str) -> Column:
    """The warping distance of two columns of arrays of doubles, null where one is null or empty."""
    return _udf()(F.col(a), F.col(b))
