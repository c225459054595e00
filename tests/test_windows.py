"""Windows, searches and files against plain loops, written from the rules and not from the SQL."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.ma import PERIODS, golden_cross
from barline.operators import golden, history, learning, patterns, screen, search, stages, verdicts
from barline.sources import bars as sources

DAY = datetime.date(2020, 1, 1)


def walk(seed, n=400, steps=(-300, -100, 100, 200, 300)):
    rng, close, out = random.Random(seed), 100_000, []
    for i in range(n):
        close += rng.choice(steps) + (60 if (i // 30) % 2 else -40)
        out.append(close)
    return out


def frame(spark, series):
    rows = [(c, DAY + datetime.timedelta(days=i), x, 10 + (i * 7) % 13) for c, s in series.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "code string, ts date, close long, vol long")


def averages(closes):
    return {k: [None if i < k - 1 else sum(closes[i - k + 1 : i + 1]) / k for i in range(len(closes))] for k in PERIODS}


def judged(closes, a, b):
    """The three rules for the window of days a .. b of a series with a bar every day."""
    lo = max(0, a - 100)
    ma = averages(closes[lo : b + 101])
    valid = range(46, len(closes[lo : b + 101]))
    drop = lambda i: [k for k in PERIODS if ma[k][i] <= ma[k][i - 1]]
    before, target = [i for i in valid if i + lo < a], [i for i in valid if a <= i + lo <= b]
    if len(target) < 2:
        return ("unknown",) * 3
    dropped = any(drop(i) == [4] for i in before[1:])
    joint = [4 in drop(i) and len(drop(i)) > 1 for i in target[1:]]
    two = all(not drop(i) and all(ma[p][i] > ma[q][i] for p, q in zip(PERIODS, PERIODS[1:], strict=False)) for i in target[1:])
    one = all(6 - len(drop(i)) >= 4 for i in target[1:])
    live = "stage3" if dropped and not any(joint) else "stage2" if two and len(target) > 3 else "stage1" if one and len(target) > 3 else "unknown"
    ends = one and joint[-1] and not any(joint[:-1])
    rest = "stage2" if two else "stage1" if one else "unknown"
    return live, "stage3" if ends else rest, "stage3" if ends and dropped else rest


def test_window_verdicts(spark):
    series = {"a": walk(1), "b": walk(2), "c": walk(3, 60)}
    bars = frame(spark, series)
    windows = [(c, i, i + size) for c, s in series.items() for size in (0, 1, 2, 3, 7) for i in range(0, len(s) - size, 3)]
    # Segments meet the conditions more often than places at random do.
    windows += [(r.code, r.lo + 46, r.hi + 46) for r in stages.stage_positions(stages.rolling_sums(bars)).collect()]
    day = lambda i: DAY + datetime.timedelta(days=i)
    asked = spark.createDataFrame([(c, day(a), day(b)) for c, a, b in sorted(set(windows))], "code string, start date, end date")
    got = {(r.code, (r.start - DAY).days, (r.end - DAY).days): (r.live, r.second, r.backup) for r in verdicts.window_verdicts(asked, bars).collect()}
    assert got == {w: judged(series[w[0]], *w[1:]) for w in set(windows)}
    for rule in range(3):
        assert {v[rule] for v in got.values()} == {"unknown", "stage1", "stage2", "stage3"}


def test_screen_keeps_what_still_holds(spark):
    series = {f"{i}": walk(i, 140, (-200, -100, 150, 300, 400)) for i in range(40)}
    sums = stages.rolling_sums(frame(spark, series))
    got = {r.code: (r.lo, r.hi, r.stage) for r in screen.current_stage(sums, 30).collect()}
    wanted, seen = {}, set()
    windows = {k: screen.recent_windows(sums, 30, 3, k).collect() for k in (2, 1)}
    for code, closes in series.items():
        ma = {k: v[-30:] for k, v in averages(closes).items()}
        fell = lambda i: i > 0 and ma[4][i - 1] > ma[20][i - 1] and ma[4][i] < ma[20][i]  # noqa: B023, E731
        two = [(r.lo, r.hi, "stage2") for r in windows[2] if r.code == code and not any(fell(i) for i in (r.hi - 1, r.hi)) and r.hi == 29 and not ma[4][29] < ma[4][28]]
        one = [(r.lo, r.hi, "stage1") for r in windows[1] if r.code == code and not any(fell(i) for i in (r.hi - 1, r.hi))]
        seen |= {"fell" for r in windows[1] if r.code == code and any(fell(i) for i in (r.hi - 1, r.hi))} | {"old" for r in windows[2] if r.code == code and r.hi < 29}
        if two or one:
            wanted[code] = max(two or one, key=lambda w: (w[1], -w[0]))
    assert got == wanted
    assert {w[2] for w in wanted.values()} == {"stage1", "stage2"} and "old" in seen


def warped(a, b):
    d = np.full((len(a), len(b)), np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            c = abs(a[i] - b[j])
            d[i, j] = c if i == j == 0 else min(d[i - 1, j - 1] + 2 * c if i and j else np.inf, d[i - 1, j] + c if i else np.inf, d[i, j - 1] + c if j else np.inf)
    return d[-1, -1]


def unify(a, b):
    n = max(len(a), len(b))
    long = lambda x: np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(x)), x) if len(x) > 1 else np.full(n, x[0])
    return long(a), long(b)


def crossed(own, target, weights, golden):
    sums = dict.fromkeys(weights, 0.0)
    places = lambda u, v: [i for i in range(1, len(u)) if u[i - 1] <= v[i - 1] and u[i] > v[i]]
    for i, p in enumerate(PERIODS):
        for q in PERIODS[i + 1 :]:
            for kind, (u, v) in (("golden", (p, q)), ("death", (q, p))):
                x, y = places(own[u], own[v]), places(target[u], target[v])
                sums[f"{kind}_count"] += 1 - abs(len(x) - len(y)) / (max(len(x), len(y), 1) + 1e-10)
                size = len(target[p])
                if not x or not y:
                    at = float(len(x) == len(y))
                else:
                    a, b = unify(x, y)
                    at = 1 - min(abs(a.mean() - b.mean()) / size, 1) if len(a) < 2 else 1 - warped(a, b) / (size * len(a) + 1e-10)
                sums[f"{kind}_position"] += at
    mean = {k: 1.0 if k.startswith("golden") and not golden else v / 15 for k, v in sums.items()}
    return sum(mean[k] * w / sum(weights.values()) for k, w in weights.items())


@pytest.mark.parametrize(("weights", "golden"), [(patterns.CROSS_WEIGHTS, True), ({"golden_count": 1, "golden_position": 0, "death_count": 2, "death_position": 5}, False)])
def test_crossover_similarity(spark, weights, golden):
    rng = random.Random(5)
    lines = {c: {k: [rng.randrange(9) + (k == 4) * i % 3 for i in range(n)] for k in PERIODS} for c, n in (("t", 20), ("u", 20), ("v", 13), ("w", 5), ("x", 20))}
    lines["x"] = {k: [float(k)] * 20 for k in PERIODS}
    rows = spark.createDataFrame([(c, *[[float(v) for v in m[k]] for k in PERIODS]) for c, m in lines.items()], "code string, " + ", ".join(f"m{k} array<double>" for k in PERIODS))
    got = {r.code: r.crossover for r in patterns.crossover_similarity(rows, "t", weights, golden).collect()}
    assert got == {c: pytest.approx(crossed(m, lines["t"], weights, golden), abs=1e-6) for c, m in lines.items()}


def test_weights_are_divided_by_their_sum():
    given = {"a": 1.0, "b": 3.0}
    assert patterns.normalised(given) == {"a": 0.25, "b": 0.75} and given == {"a": 1.0, "b": 3.0}
    with pytest.raises(ValueError):
        patterns.normalised({"a": 0.0})


def test_golden_intervals(spark):
    closes = walk(7, 1500)
    bars = frame(spark, {"a": closes})
    sums = stages.rolling_sums(bars)
    ma = {k: v[46:] for k, v in averages(closes).items()}
    close, vol = closes[46:], [10 + (i * 7) % 13 for i in range(46, 1500)]
    hits = [i for i in range(1, len(close)) if ma[4][i - 1] <= ma[12][i - 1] and ma[4][i] > ma[12][i] and vol[i] > vol[i - 1] and (i <= 10 or close[i] > close[i - 9])]
    runs = []
    for i in hits:
        runs = [*runs[:-1], (runs[-1][0], i)] if runs and i - runs[-1][1] <= 1 else [*runs, (i, i)]
    mean = lambda p: sum((x - p[0]) / p[0] * 100 for x in p[1:]) / (len(p) - 1) if len(p) > 1 else 0.0
    wanted = [(46 + a, 46 + b, pytest.approx(mean(close[b + 1 : b + 6]), abs=1e-6)) for a, b in runs]
    index = spark.createDataFrame([(DAY, 1, 2)], "ts date, s4 long, s47 long")
    found = golden.matching_intervals(sums, index, golden_cross(4, 12), arranged=False)
    assert [((r.start - DAY).days, (r.end - DAY).days, r.five_day_return) for r in found.orderBy("k").collect()] == wanted and len(wanted) > 5
    top = golden.first_intervals(found).collect()
    assert len(top) == 5 and top[0].overall_return == pytest.approx(np.mean([mean(close[b + 1 : b + 6]) for _, b in runs]), abs=1e-6)
    assert golden.matching_bars(sums, lambda: F.col("n") == 3, arranged=False, filtered=False).count() == 1


def test_positions_of_days(spark):
    bars = spark.createDataFrame([("a", DAY + datetime.timedelta(days=d), n) for n, d in enumerate((0, 2, 3, 9))], "code string, ts date, n int")
    day = lambda d: DAY + datetime.timedelta(days=d)
    points = spark.createDataFrame([("a", day(d)) for d in (-1, 0, 1, 5, 20)] + [("b", DAY)], "code string, ts date")
    assert {(r.code, (r.ts - DAY).days): r.n for r in history.last_bars(points, bars).collect()} == {("a", -1): None, ("a", 0): 0, ("a", 1): 0, ("a", 5): 2, ("a", 20): 3, ("b", 0): None}
    ranges = spark.createDataFrame([("a", day(a), day(b)) for a, b in ((-5, 2), (1, 8), (4, 8), (3, 50), (-9, -1))], "code string, start date, end date")
    assert {((r.start - DAY).days, r.lo, r.hi) for r in history.inside(ranges, bars).collect()} == {(-5, 0, 1), (1, 1, 2), (3, 2, 3)}
    rows = history.with_history(ranges.where(F.col("start") == day(3)), bars, 1).collect()
    assert sorted((r.n, r.part, r.n_history, r.n_target) for r in rows) == [(1, "history", 1, 2), (2, "target", 1, 2), (3, "target", 1, 2)]
    marked = spark.createDataFrame([("a", n, n // 2) for n in range(6)] + [("b", 0, 1)], "code string, n int, label int")
    assert sorted((r.label, r.first, r.n) for r in history.before_first(marked.withColumn("ts", F.lit(DAY)), 3).collect()) == [(1, 2, 0), (1, 2, 1), (2, 4, 1), (2, 4, 2), (2, 4, 3)]


def test_names_and_rankings(spark):
    rows = spark.createDataFrame([("a", DAY, None), ("a", DAY + datetime.timedelta(days=1), "x"), ("a", DAY + datetime.timedelta(days=2), "y"), ("b", DAY, None)], "code string, ts date, name string")
    names = history.first_name(rows)
    assert {r.code: r.name for r in history.named(rows.select("code").distinct(), names).collect()} == {"a": "x", "b": "b"}
    report = spark.createDataFrame([("b", 2, 0.901), ("a", 4, 0.899), ("a", 2, 0.95), ("a", 0, 0.9)], "code string, lo long, similarity double")
    assert [(r.code, r.lo) for r in search.ranked(report).orderBy("rank").collect()] == [("a", 2), ("a", 0), ("a", 4), ("b", 2)]
    assert {(r.code, r.lo, r["rank"]) for r in search.ranked(report, per_code=1).collect()} == {("a", 2, 1), ("b", 2, 1)}


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "000021.csv").write_text("﻿timestamps,close,MA4,extra\n2020-01-01,2.5,7,z\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('vol,name,code,timestamps,close\n9,"n, m",600000,20200102,x\n8,"n, m",600000,20200102,3\n')
    got = sources.read_csv_bars(spark, str(tmp_path), extra=("MA4",)).orderBy("code").collect()
    assert [(r.code, r.ts, r.close, r.MA4, r.vol, r.name) for r in got] == [("000021", DAY, 2.5, 7.0, None, None), ("600000", DAY + datetime.timedelta(days=1), 3.0, None, 8.0, "n, m")]
    assert sources.read_csv_bars(spark, str(tmp_path), pool=spark.createDataFrame([("21.SZ",)], "code string")).count() == 1
    (tmp_path / "names.csv").write_text("feature\nb\na\n")
    assert sources.read_feature_names(spark, str(tmp_path / "names.csv")) == ["b", "a"]
    held = spark.createDataFrame([("a", "f1", DAY), ("a", "f1", DAY + datetime.timedelta(days=9)), ("a", "f2", DAY)], "code string, file string, ts date")
    asked = spark.createDataFrame([("a", DAY, DAY + datetime.timedelta(days=3)), ("b", DAY, DAY)], "code string, start date, end date")
    assert [(r.code, r.file) for r in sources.covering_files(held, asked).collect()] == [("a", "f1")]


def test_sinks(spark, tmp_path):
    (tmp_path / "modes.json").write_text('[{"index": "1", "name": "m", "lines": ["a"], "savedBrushTimeRanges": [{"code": "a", "startDate": "s", "endDate": "e", "saveTime": 1}]}, {"index": "2", "name": "n"}]')
    modes = sources.read_registry(spark, str(tmp_path / "modes.json"))
    sources.write_registry(modes, str(tmp_path / "out"))
    back = {r["index"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert back["1"].savedBrushTimeRanges[0].code == "a" and not back["2"].savedBrushTimeRanges
    rows = spark.createDataFrame([("a", [("s", 1.5), ("t", 2.5)]), ("b", [])], "code string, items array<struct<stage:string,x:double>>")
    assert sorted(map(tuple, sources.flattened(rows).collect())) == [("a", "s", 1.5), ("a", "t", 2.5)]
    assert sources.as_json(rows.where("code = 'a'")).first().json == '{"code":"a","items":[{"stage":"s","x":1.5},{"stage":"t","x":2.5}]}'
    assert sources.renamed(rows, {"code": "ts_code"}, stage=2).columns == ["ts_code", "stage"]
    parts = spark.createDataFrame([("a", 1, 2, [0.5, 1.0])], "code string, fragment_id int, label int, feature_vector array<double>")
    sources.write_fragments(parts, str(tmp_path / "fragments"))
    sources.write_summary(parts, str(tmp_path / "summary"))
    assert spark.read.parquet(str(tmp_path / "fragments")).first().label == 2
    assert spark.read.csv(str(tmp_path / "summary"), header=True).first().feature_vector == "0.5,1.0"


def test_classifier_hooks(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 0.0), ("b", 2, None, 4.0)], "code string, lo int, x double, other double")
    found = learning.classified(rows, ["x", "y"], lambda f: pd.DataFrame({"p": f["x"] / 4 + f["y"], "q": 1 - f["x"] / 4}), 2, ["code", "lo"])
    assert {(r.code, r.lo): r.probabilities for r in found.collect()} == {("a", 1): {"class1": 0.25, "class2": 0.75}, ("b", 2): {"class1": 0.0, "class2": 1.0}}
    segments = spark.createDataFrame([("a", "stage1", 1, 5, "long"), ("a", "stage2", 6, 8, "short")], "code string, stage string, lo int, hi int, duration_type string")
    model = lambda part: part.withColumn("probabilities", F.create_map(F.lit("class1"), F.lit(1.0)))
    assert {r.stage: r.probabilities for r in learning.by_duration(segments, {("stage1", "long"): model}).collect()} == {"stage1": {"class1": 1.0}, "stage2": {}}
    assert all(r.probabilities == {} for r in learning.by_duration(segments, {}).collect() + verdicts.with_probabilities(segments).collect())
    schema = T.StructType([T.StructField("bars", T.LongType()), T.StructField("none", T.DoubleType())])
    bars = frame(spark, {"a": walk(1, 70), "b": walk(2, 5)})
    assert {(r.code, r.bars, r.none) for r in learning.extracted(bars, lambda g: {"bars": len(g)}, schema).collect()} == {("a", 60, None), ("b", 5, None)}


def test_trees_splits_and_evaluation(spark):
    tree = ("max", ("div", "x", "y"), ("log", ("neg", ("sqrt", "x"))), ("mul", 2, ("sin", ("sub", "y", "y"))))
    assert learning.readable(tree) == "max((x / y), log(-(sqrt(x))), (2 * sin((y - y))))"
    rows = spark.createDataFrame([(4.0, 2.0), (4.0, 0.0), (-9.0, 1.0)], "x double, y double")
    assert [r[0] for r in rows.select(learning.expression(tree)).collect()] == [pytest.approx(2.0), pytest.approx(1.0), pytest.approx(np.log(3))]
    data = spark.createDataFrame([(i, i % 2, float(i % 2 + i % 7 / 10), float(i % 5)) for i in range(400)], "id long, label int, good double, bad double")
    parts = learning.split(data, "id")
    assert 0.6 < parts.where("part = 'train' and label = 1").count() / 200 < 0.8
    accuracy, importance = learning.evaluate(parts, ["bad", "good"], trees=10)
    assert accuracy > 0.95 and importance[0][0] == "good"
    sums = stages.rolling_sums(frame(spark, {"a": walk(1, 80), "b": walk(2, 80)})).withColumn("stage", (F.col("n") < 20).cast("int"))
    labels = spark.createDataFrame([("a", "up"), ("b", "down")], "code string, class string")
    assert {r.code: r.label for r in learning.labelled_last_bars(sums, labels, 1).collect()} == {"a": 1, "b": 0}
