"""Last-bar features, the older score, both look-backs and whole ranks against loops written from the rules."""

import datetime
import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barline.functions import scalars, warping
from barline.functions.ma import PERIODS
from barline.operators import golden, patterns, returns, screen, search, stages

DAY = datetime.date(2021, 1, 1)


def bars_of(spark, sizes, seed=1, vols=(0, 1, 2, 3)):
    rng, rows = random.Random(seed), []
    for code, n in sizes.items():
        close = 20_000
        for i in range(n):
            close += rng.choice((-100, 0, 0, 100, 130))
            rows.append((code, DAY + datetime.timedelta(days=i), close - 5, close + 20, close - 30, close, rng.choice(vols)))
    return spark.createDataFrame(rows, "code string, ts date, open long, high long, low long, close long, vol long"), rows


def last_bar(c, v):
    """Features of the last bar of closes and volumes that have averages, whose first 46 are the warm-up."""
    ma = {k: [sum(c[i - k + 1 : i + 1]) / k for i in range(46, len(c))] for k in PERIODS}
    c, v = c[46:], v[46:]
    n, f = len(c), {}
    pairs = list(itertools.pairwise(PERIODS))
    if n > 10:
        for k in (4, 8, 20):
            f |= {f"ma{k}_ma47_ratio": ma[k][-1] / ma[47][-1], f"ma{k}_ma47_diff": ma[k][-1] - ma[47][-1]}
        f |= {f"ma{k}_slope": ma[k][-1] / ma[k][-5] - 1 for k in PERIODS}
        f["bullish_alignment"] = int(all(ma[p][-1] > ma[q][-1] for p, q in pairs))
        f["bearish_alignment"] = int(all(ma[p][-1] < ma[q][-1] for p, q in pairs))
        for k in (4, 20):
            f[f"ma{k}_direction_change"] = int(ma[k][-1] > ma[k][-2] < ma[k][-3])
            f[f"ma{k}_acceleration"] = (ma[k][-1] - ma[k][-2]) - (ma[k][-2] - ma[k][-3])
    if n > 5:
        for k in (4, 8, 20, 47):
            f |= {f"price_ma{k}_ratio": c[-1] / ma[k][-1], f"price_above_ma{k}": int(c[-1] > ma[k][-1])}
        f |= {f"price_cross_ma{k}": int(c[-2] <= ma[k][-2] and c[-1] > ma[k][-1]) for k in (4, 20)}
        f["price_up_volume_down"] = int(c[-1] > c[-2] and v[-1] < v[-2])
        f["price_down_volume_down"] = int(c[-1] < c[-2] and v[-1] < v[-2])
        f["ma_up_volume_up"] = int(ma[20][-1] > ma[20][-2] and v[-1] > v[-2])
        f["ma_down_volume_up"] = int(ma[20][-1] < ma[20][-2] and v[-1] > v[-2])
        f |= {f"ma{k}_std": statistics.stdev(ma[k][-5:]) for k in (4, 8, 20)}
        f["ma4_ma20_std_ratio"] = f["ma4_std"] / f["ma20_std"] if f["ma20_std"] > 0 else 0
        f["ma4_ma20_spread"] = abs(ma[4][-1] - ma[20][-1])
        f["bullish_strength"] = sum(ma[p][-1] > ma[q][-1] for p, q in pairs) / 5
        f["bearish_strength"] = sum(ma[p][-1] < ma[q][-1] for p, q in pairs) / 5
        f["trend_consistency"] = max(f["bullish_strength"], f["bearish_strength"])
        f |= {"price_std_5": statistics.stdev(c[-5:]), "volume_std_5": statistics.stdev(v[-5:])}
    if n > 1:
        f["price_change"] = c[-1] / c[-2] - 1
    return f | {f"ma{k}": ma[k][-1] for k in PERIODS}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_last_bar_features(spark, seed):
    df, rows = bars_of(spark, {str(n): n for n in (47, 48, 51, 52, 56, 57, 58, 80, 90, 100, 110, 120)}, seed)
    got = {r.code: r.asDict() for r in screen.last_bar_features(stages.rolling_sums(df)).collect()}
    seen = set()
    for code in got:
        own = [r for r in rows if r[0] == code]
        f = last_bar([r[5] for r in own], [r[6] for r in own])
        seen |= {k for k, x in f.items() if x}
        for name, value in got[code].items():
            if name not in ("code", "close", "open", "high", "low", "vol", "volume_change", "ma4_ma20_spread_change"):
                assert math.isclose(value, f.get(name, 0), rel_tol=1e-4, abs_tol=1.1e-4), (code, name, value, f.get(name, 0))
        assert "trend_strength" not in got[code]
    assert {"trend_consistency", "bullish_strength"} <= seen


def warp(a, b):
    far = math.inf
    d = [[far] * len(b) for _ in a]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            cost = abs(x - y)
            d[i][j] = cost if not i and not j else min(d[i - 1][j] + cost if i else far, d[i][j - 1] + cost if j else far, d[i - 1][j - 1] + 2 * cost if i and j else far)
    return d[-1][-1]


def test_older_crossover_warps_places_as_they_are(spark):
    df, _ = bars_of(spark, {str(k): 47 + 40 for k in range(8)}, 9)
    lines = {r.code: r.asDict() for r in patterns.series(stages.rolling_sums(df), 40).collect()}
    got = {r.code: r.crossover for r in patterns.crossover_similarity(patterns.series(stages.rolling_sums(df), 40), "0", resampled=False).collect()}

    def places(up, low):
        return [i for i in range(1, len(up)) if up[i - 1] <= low[i - 1] and up[i] > low[i]]

    uneven = 0
    for code, own in lines.items():
        parts = []
        for p, q in patterns.CROSS_PAIRS:
            for a, b in (((own[f"m{p}"], own[f"m{q}"]), (lines["0"][f"m{p}"], lines["0"][f"m{q}"])), ((own[f"m{q}"], own[f"m{p}"]), (lines["0"][f"m{q}"], lines["0"][f"m{p}"]))):
                x, y = places(*a), places(*b)
                uneven += bool(x and y and len(x) != len(y))
                count = 1 - abs(len(x) - len(y)) / (max(len(x), len(y), 1) + 1e-10)
                place = 1 - warp(x, y) / (40 * max(len(x), len(y))) if x and y else float(len(x) == len(y))
                parts.append((count + place) / 2)
        assert math.isclose(got[code], sum(parts) / len(parts), abs_tol=2e-6)
    assert uneven
    newer = {r.code: r.crossover for r in patterns.crossover_similarity(patterns.series(stages.rolling_sums(df), 40), "0").collect()}
    assert any(abs(newer[c] - got[c]) > 1e-4 for c in got)


def test_each_stage_in_its_own_span(spark):
    df, _ = bars_of(spark, {str(k): 47 + 60 for k in range(60)}, 4)
    sums = stages.rolling_sums(df)
    found = {r.code: r for r in screen.current_stage(sums, 20, 3, 30).collect()}
    two = {r.code: r for r in screen.current_stage(sums, 20, 3).where("stage = 'stage2'").collect()}
    one = {r.code: r for r in screen.current_stage(sums, 30, 3).collect()}
    assert {c for c, r in found.items() if r.stage == "stage2"} == set(two) and all(found[c] == two[c] for c in two)
    for code, r in found.items():
        if r.stage == "stage1" and one[code].stage == "stage1":
            assert r == one[code]
    assert any(r.stage == "stage1" for r in found.values())


def test_older_search(spark):
    """The mean leaves out intervals without a later bar; the return starts at the interval's last bar."""
    df, rows = bars_of(spark, {str(k): 47 + 40 + k for k in range(12)}, 6)
    sums = stages.rolling_sums(df)
    index = returns.index_sums(df.groupBy("ts").agg(F.expr("sum(close) div count(*)").alias("close")))
    found = golden.matching_intervals(sums, index, older=True).collect()
    total = []
    for r in found:
        closes = [x[5] for x in rows if x[0] == r.code]
        days = [x[1] for x in rows if x[0] == r.code]
        own = closes[days.index(r.end) : days.index(r.end) + 5]
        steps = [(b - a) / a for a, b in itertools.pairwise(own)]
        assert (r.five_day_return is None) == (not steps) and (not steps or math.isclose(r.five_day_return, sum(steps) / len(steps), abs_tol=1e-12))
        total += [sum(steps) / len(steps)] if steps else []
    first = golden.first_intervals(golden.matching_intervals(sums, index, older=True), 2, older=True).collect()
    assert total and len(first) < len(found) and all(math.isclose(r.overall_return, sum(total) / len(total), abs_tol=1e-12) and r.five_day_return is not None for r in first)


def test_ranks_of_groups(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), i, rng.choice((0.7, 0.71, 0.714, 0.9))) for i in range(300)]
    report = spark.createDataFrame(rows, "code string, lo long, similarity double")
    monkeypatch.setattr(search, "RANKED", 16)
    got = sorted((r["rank"], r.code, r.lo, r.similarity) for r in search.ranked(report).collect())
    order = sorted(((-round(s, 2), c, i) for c, i, s in rows))
    assert got == [(k + 1, c, i, -s) for k, (s, c, i) in enumerate(order)]


def test_names_of_exchanges(spark):
    rows = spark.createDataFrame([("600000", "近20天"), ("000021", ""), ("300.SH", "last 5 of 9"), ("1", None)], "code string, text string")
    got = rows.select(scalars.exchange_index(F.col("code")), scalars.suffixed(F.col("code")), scalars.recent_days(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [("000001", "600000.SH", 20), ("399001", "000021.SZ", 20), ("000001", "300.SH.SZ", 5), ("399001", "1.SZ", 20)]


def test_long_patterns_in_blocks(spark, monkeypatch):
    """Windows across blocks, of a pattern longer than a block, against a loop; bars are exchanged once, whatever the length."""
    df, rows = bars_of(spark, {"a": 47 + 90, "b": 47 + 50, "c": 47 + 20}, 8)
    sums = stages.rolling_sums(df).cache()
    lines = {}
    for code in "abc":
        c = [r[5] for r in rows if r[0] == code]
        lines[code] = [[sum(c[i - k + 1 : i + 1]) / k for k in PERIODS] for i in range(46, len(c))]
    pattern = [x for row in lines["a"][7:37] for x in row]

    def score(x, y):
        mx, my = sum(x) / len(x), sum(y) / len(y)
        dx, dy = statistics.pstdev(x), statistics.pstdev(y)
        zx, zy = [(v - mx) / dx for v in x], [(v - my) / dy for v in y]
        r = sum(a * b for a, b in zip(zx, zy, strict=True)) / len(x)
        tx, ty = zx[-1] - zx[0], zy[-1] - zy[0]
        trend = (1 + ((tx * ty > 0) - (tx * ty < 0)) * (min(abs(tx), abs(ty)) / max(abs(tx), abs(ty)))) / 2
        return 0.4 * trend + 0.3 * math.exp(-2 * (1 - r)) + 0.3 * r

    expected = {(code, i): score([x for row in own[i : i + 30] for x in row], pattern) for code, own in lines.items() for i in range(0, len(own) - 29, 3)}
    for block in (8, 1 << 16):
        monkeypatch.setattr(patterns.blocks, "BLOCK", block)
        found = patterns.similar_windows(sums, "a", 7, 30, 3)
        got = {(r.code, r.start): r.similarity for r in found.collect()}
        assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=2e-5) for k in got)  # closes far from BASE lose digits
    assert patterns.similar_windows(sums, "c", 7, 30).collect() == []  # no such pattern


def test_warping_of_batches():
    rng = random.Random(5)
    a = [[rng.random() for _ in range(rng.randint(1, 9))] for _ in range(80)]
    b = [[rng.random() for _ in range(rng.randint(1, 9))] for _ in range(80)]
    got = warping.warp_all([*a, None, [1.0]], [*b, [1.0], []])
    assert all(math.isclose(x, warp(p, q)) for x, p, q in zip(got, a, b, strict=False)) and all(map(math.isnan, got[80:]))


def test_only_what_may_be_among_the_first_is_warped(spark, monkeypatch):
    """The pruned search gives what warping all gives, and warps fewer."""
    rng = random.Random(6)
    rows = []
    for c in range(24):
        level, drift = 10_000_000, rng.choice((-30, 0, 30))
        walk = []
        for _ in range(80):
            level += rng.choice((-100, 100)) + (drift if c else 0)
            walk.append(float(level - patterns.BASE))
        rows.append((f"c{c:02d}", *[[v + 0.1 * k * i % 7 for i, v in enumerate(walk)] for k in PERIODS]))
    df = spark.createDataFrame(rows, "code string, " + ", ".join(f"m{k} array<double>" for k in PERIODS)).cache()
    got = [tuple(r) for r in patterns.group_similarity(df, "c00", 5).collect()]
    lines = df.select("code", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("a")) for k in PERIODS])).alias("l")).select("code", "l.*")
    both = lines.join(lines.where("code = 'c00'").select("k", F.col("a").alias("b")), "k")
    every = patterns.pair_similarities(both, "code", "k")
    mean = every.groupBy("code").agg((sum((F.sum(n) * w for n, w in patterns.WEIGHTS.items()), F.lit(0.0)) / 6).alias("lines"))
    whole = mean.join(patterns.crossover_similarity(df, "c00"), "code").select("code", F.round(0.6 * F.col("lines") + 0.4 * F.col("crossover"), 6).alias("similarity"))
    assert got == [tuple(r) for r in whole.orderBy(F.desc("similarity"), "code").limit(5).collect()]
    pairs = patterns.pair_metrics(both, "code", "k")
    close = patterns.warped(pairs).withColumn("bound", patterns._near_warp(patterns.least_warp(F.col("a"), F.col("b")))).select("dtw", "bound").collect()
    assert all(r.bound >= r.dtw - 1e-6 for r in close)
    seen = []
    monkeypatch.setattr(patterns, "warped", lambda p, f=patterns.warped: (seen.append(p.count()), f(p))[1])
    patterns.group_similarity(df, "c00", 5)
    assert seen[0] == 5 * 6 and seen[1] < 24 * 6


def test_function_of_a_prefix(spark):
    """A Python function sees the bars that it asks for, across blocks, and no others."""
    df, rows = bars_of(spark, {"a": 70, "b": 3}, 2)
    numbered = patterns.blocks.numbered(df).drop("block")
    for block in (4, 4096):
        got = golden.python_matches(numbered, lambda p: len(p) == 6 and p["close"].iat[-1] == p["close"].max(), 6, block)
        c = [r[5] for r in rows if r[0] == "a"]
        assert sorted((r.code, r.n) for r in got.collect()) == [("a", i) for i in range(5, 70) if c[i] == max(c[i - 5 : i + 1])]
    whole = golden.python_matches(numbered, lambda p: len(p) < 3, 3)
    assert sorted((r.code, r.n) for r in whole.collect()) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    crossed = lambda p: len(p) == 2 and p["s4"].iat[0] * 12 <= p["s12"].iat[0] * 4 and p["s4"].iat[1] * 12 > p["s12"].iat[1] * 4
    sums = stages.rolling_sums(df)
    plain = golden.matching_bars(sums, golden.golden_cross(4, 12), arranged=False, filtered=False)
    assert sorted(r.ts for r in golden.python_matches(sums, crossed, 2, 8).collect()) == sorted(r.ts for r in plain.collect())
