"""MaxScore against the sorted scores of all candidates."""

import numpy as np
import pytest

from barline.llm import maxscore

SCHEMA = "vec_id long, vector array<long>, score long, rank string"  # clashing names beside


def best(queries, candidates, k):
    out = []
    for q, v in {(q, tuple(v)) for q, v in queries if q is not None and v is not None and None not in v}:
        found = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), c) for c, w in candidates if c is not None and c != q and w is not None and None not in w)
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(found[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else int(x) for x in v], 1, "r") for i, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"shard": 40, "block": 3}])
@pytest.mark.parametrize("low", [-2, -900, 0])
def test_ties_negative_values_and_repeats(spark, sizes, low):
    rng = np.random.default_rng(abs(low))
    rows = [(int(i), rng.integers(low, 3 if low > -9 else -100, 6).tolist()) for i in range(150)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (200, [0] * 6), (201, [1, 2]), (202, []), (None, [1] * 6), (203, None), (204, [1, None, 1, 1, 1, 1])]
    asked = [r for r in rows if r[0] is None or r[0] % 25 < 8]
    got = maxscore.top_k(frame(spark, asked), frame(spark, rows), **sizes).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == best(asked, rows, 5)


def test_values_beyond_floats(spark):
    rows = [(i, [(1 << 29) + i, (1 << 29) - 3 * i]) for i in range(40)]
    got = maxscore.top_k(frame(spark, rows[:3]), frame(spark, rows), k=4, shard=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == best(rows[:3], rows, 4)


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, [(1, [1, 2])])
    assert maxscore.top_k(none, some).count() == maxscore.top_k(some, none).count() == maxscore.top_k(some, some).count() == 0
    assert maxscore.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_work_falls_with_the_bar():
    rng = np.random.default_rng(1)
    rows = (rng.normal(size=(4000, 32)) ** 3 * 40).astype(np.int64) * (rng.random((4000, 32)) < 0.3)
    query = rows[5]
    exact = np.sort(rows @ query)[::-1]
    work = []
    for bar in (1, int(exact[400]), int(exact[5])):
        index = maxscore.Index.of(np.arange(4000), rows)
        ids, score = index.search(-1, query, 5, bar)
        assert score.tolist() == exact[:5].tolist()
        work.append(sum(index.work.values()))
    assert work[0] >= work[1] >= work[2]
    assert work[2] < np.count_nonzero(rows[:, query != 0]) / 2
