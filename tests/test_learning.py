"""Models of segments against plain loops."""

import datetime
import math
import random

from pyspark.sql import functions as F

from barline.operators import learning, stages

DAY = datetime.date(2021, 1, 1)


def test_naive_bayes(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        kind, y = rng.choice("ab"), rng.randrange(2)
        rows.append((i, kind, y if rng.random() < 0.9 else None, rng.gauss(y, 1), rng.gauss(-y, 2) if rng.random() < 0.95 else None, 7.0))
    rows += [(900 + i, "one", 1, float(i), 0.0, 0.0) for i in range(5)] + [(990, None, 1, 0.0, 0.0, 0.0), (991, None, 0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, kind string, y int, f double, g double, still double").repartition(3)
    models = learning.fitted(df, ["f", "g", "still"], "y", "kind")
    assert set(models) == {("a",), ("b",)}  # `one` has a single class, null is no key
    got = {r.id: r for r in learning.predicted(df, ["f", "g", "still"], models, "kind").collect()}
    for kind in "ab":
        own = [r for r in rows if r[1] == kind and r[2] is not None]
        parts = {}
        for y in (0, 1):
            cells = [[x or 0.0 for x in r[3:]] for r in own if r[2] == y]
            means = [sum(c) / len(cells) for c in zip(*cells, strict=True)]
            parts[y] = (len(cells) / len(own), means, [sum((x - m) ** 2 for x in c) / len(cells) + learning.SMOOTH for c, m in zip(zip(*cells, strict=True), means, strict=True)])
        for r in (r for r in rows if r[1] == kind):
            p = {y: math.log(s) + sum(-0.5 * math.log(2 * math.pi * v) - ((x or 0.0) - m) ** 2 / (2 * v) for x, m, v in zip(r[3:], means, var, strict=True)) for y, (s, means, var) in parts.items()}
            up = 1 / (1 + math.exp(p[0] - p[1]))
            assert math.isclose(got[r[0]].up, up, rel_tol=1e-9) and got[r[0]].prediction == (up > 0.5)
    assert len(got) == 400 and learning.predicted(df, ["f"], {}, "kind").collect() == []


def test_history_of_a_segment(spark):
    """Features of a segment's bars come from 50 days before its start on, whatever lies before."""
    rng, rows, close = random.Random(3), [], 50_000
    for i in range(47 + 120):
        close += rng.choice((-100, 50, 120))
        rows.append(("x", DAY + datetime.timedelta(days=i), close, close, close, close, rng.randrange(9)))
    sums = stages.rolling_sums(spark.createDataFrame(rows, "code string, ts date, open long, high long, low long, close long, vol long"))
    days = {r.n: r.ts for r in sums.select("n", "ts").collect()}
    segments = spark.createDataFrame([("x", "stage2", 100, 104, days[100], days[104]), ("x", "stage1", 2, 4, days[2], days[4])], "code string, stage string, lo int, hi int, start date, end date")
    got = learning.segment_rows(segments, sums).collect()
    assert sorted((r.stage, r.n) for r in got) == [("stage1", n) for n in (2, 3, 4)] + [("stage2", n) for n in range(100, 105)]
    by = {r.n: r for r in got}
    assert all(by[n].bullish_strength == 0 == by[n].ma4_slope for n in (2, 3, 4))  # five bars at most
    whole = {r.ts: r for r in learning.bar_features(sums).collect()}
    assert all(by[n].ma4_slope == whole[days[n]].ma4_slope and by[n].price_std_5 == whole[days[n]].price_std_5 for n in range(100, 105))


def test_models_of_segments_need_both_classes(spark):
    none = spark.createDataFrame([], "kind string, y int, f double")
    assert learning.fitted(none, ["f"], "y", "kind") == {}
    assert learning.predicted(none.withColumn("z", F.lit(1)), ["f"], {}, "kind").columns == ["kind", "y", "f", "z", "up", "prediction"]
