"""Operators against plain loops on small series."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import scalars
from barline.functions.ma import PERIODS
from barline.operators import patterns, returns, screen, stages
from barline.plans.queries import QUERIES
from barline.sources import bars as sources

DAY = datetime.date(2020, 1, 1)


def walks(spark, codes=6, n=300, seed=1):
    rng, rows = random.Random(seed), []
    for c in range(codes):
        close = 100_000
        for i in range(n):
            close += rng.choice((-300, -100, 100, 200, 300)) + (40 if (i // 40) % 2 else -20)
            rows.append((f"{c:06d}", DAY + datetime.timedelta(days=i), close, rng.randrange(100)))
    return spark.createDataFrame(rows, "code string, ts date, close long, vol long"), rows


def loop_stages(closes):
    """The rules of stage_positions, bar by bar."""
    sums = {k: [sum(closes[i - k + 1 : i + 1]) for i in range(46, len(closes))] for k in PERIODS}
    n = len(sums[4])
    up = lambda k, i: i > 0 and sums[k][i] > sums[k][i - 1]
    rc = [sum(up(k, i) for k in PERIODS) for i in range(n)]
    order = [all(sums[p][i] * q > sums[q][i] * p for p, q in zip(PERIODS, PERIODS[1:], strict=False)) for i in range(n)]
    s2 = [i >= 1 and order[i] and rc[i] == 6 for i in range(n)]
    over = lambda i: sums[4][i] * 20 > sums[20][i] * 4
    out, i = set(), 0
    while i < n:
        if not s2[i]:
            i += 1
            continue
        a = i
        while i < n and s2[i]:
            i += 1
        b = i - 1
        j = a
        while j > 1 and rc[j - 1] >= 4:
            j -= 1
        if a - j > 3:
            out.add(("stage1", j, a - 1))
            end = next((k for k in range(a, n) if k and over(k - 1) and not over(k)), n - 1 if b == n - 1 else None)
            if end is not None:
                out.add(("all", j, end))
        if b - a + 1 > 3:
            out.add(("stage2", a, b))
            if b + 1 < n and not up(4, b + 1) and all(up(k, b + 1) for k in PERIODS[1:]):
                end = next((k for k in range(b + 1, n) if not up(4, k) and rc[k] < 5), None)
                if end is not None and end >= b + 1:
                    out.add(("stage3", b + 1, end))
    return out


def test_stages_match_a_loop(spark):
    df, rows = walks(spark)
    got = stages.stage_positions(stages.rolling_sums(df)).collect()
    found = 0
    for code in {r[0] for r in rows}:
        expected = loop_stages([r[2] for r in rows if r[0] == code])
        assert {(r.stage, r.lo, r.hi) for r in got if r.code == code} == expected
        found += len(expected)
    assert found > 10


def test_empty_and_short_series(spark):
    empty = spark.createDataFrame([], "code string, ts date, close long, vol long")
    short = spark.createDataFrame([("a", DAY, 1, 1)], empty.schema)
    for df in (empty, short):
        sums = stages.rolling_sums(df)
        assert stages.stage_segments(sums).count() == 0
        assert screen.recent_windows(sums).count() == 0
        assert screen.last_bar_features(sums).count() == 0


def loop_dtw(a, b):
    d = np.full((len(a), len(b)), np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            c = abs(a[i] - b[j])
            d[i, j] = c if i == j == 0 else min(d[i - 1, j - 1] + 2 * c if i and j else np.inf, d[i - 1, j] + c if i else np.inf, d[i, j - 1] + c if j else np.inf)
    return d[-1, -1]


def test_dtw_resample_cosine(spark):
    rng = np.random.default_rng(3)
    pairs = [(rng.normal(size=5).tolist(), rng.normal(size=7).tolist()) for _ in range(4)] + [([1.0], [2.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    for (a, b), r in zip(pairs, df.select(scalars.dtw(F.col("a"), F.col("b")).alias("d"), scalars.resample(F.col("a"), 9).alias("r")).collect(), strict=True):
        assert r.d == pytest.approx(loop_dtw(a, b))
        assert r.r == pytest.approx(np.interp(np.linspace(0, 1, 9), np.linspace(0, 1, len(a)), a).tolist() if len(a) > 1 else a * 9)
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert zero.select(scalars.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_similar_windows_find_themselves(spark):
    df, _ = walks(spark, 2, 120)
    found = patterns.similar_windows(stages.rolling_sums(df), "000000", 20).where("code = '000000' and start = 20").first()
    assert found.similarity == pytest.approx(1.0)


def test_as_of_looks_back_over_years(spark):
    series = spark.createDataFrame([(datetime.date(2018, 5, 1), 7), (datetime.date(2020, 2, 1), 9)], "ts date, v int")
    days = [datetime.date(2018, 4, 30), datetime.date(2018, 5, 1), datetime.date(2020, 1, 31), datetime.date(2020, 2, 2), datetime.date(2023, 1, 1)]
    got = returns.as_of(spark.createDataFrame([(d,) for d in days], "ts date"), series, ["v"]).collect()
    assert {r.ts: r.v for r in got} == dict(zip(days, (0, 7, 7, 9, 9), strict=True))


def test_maximal_windows(spark):
    rows = [("a", 0, 5), ("a", 1, 5), ("a", 0, 4), ("a", 2, 7), ("b", 1, 2)]
    got = screen.maximal(spark.createDataFrame(rows, "code string, lo int, hi int"))
    assert sorted(map(tuple, got.collect())) == [("a", 0, 5), ("a", 2, 7), ("b", 1, 2)]


def test_non_max_suppression(spark):
    rows = [("k", 0, 0, 9, 9, 0.9), ("k", 1, 1, 10, 10, 0.8), ("k", 30, 30, 40, 40, 0.7), ("j", 0, 0, 1, 1, 0.1)]
    got = screen.non_max_suppression(spark.createDataFrame(rows, "key string, x1 int, y1 int, x2 int, y2 int, score double"), "key")
    assert sorted((r.key, r.score) for r in got.collect()) == [("j", 0.1), ("k", 0.7), ("k", 0.9)]


def suppressed(rows, threshold=0.4):
    """(key, x1, y1, x2, y2, score) of the kept rows, by a plain loop."""
    def overlap(a, b):
        both = max(min(a[3], b[3]) - max(a[1], b[1]) + 1, 0) * max(min(a[4], b[4]) - max(a[2], b[2]) + 1, 0)
        area = lambda x: (x[3] - x[1] + 1) * (x[4] - x[2] + 1)
        return both / (area(a) + area(b) - both)

    kept = []
    for x in sorted(rows, key=lambda r: (-r[5], *r[1:5])):
        if not any(k[0] == x[0] and overlap(x, k) > threshold for k in kept):
            kept.append(x)
    return sorted(kept, key=str)


@pytest.mark.parametrize(("threshold", "few"), [(0.0, 1000), (0.0, 120), (0.4, 120), (0.4, 0)])
def test_non_max_suppression_by_a_plain_loop(spark, threshold, few):
    rng = random.Random(3)
    rows = []
    for _ in range(400 if few else 60):
        x, y, size = rng.uniform(-60, 60), rng.randrange(-40, 40), rng.choice([0.3, 3, 12, 40])
        rows.append((rng.choice(["a", "b", None]), float(x), float(y), x + size * rng.uniform(0.5, 2), y + size * rng.uniform(0.5, 2), float(rng.randrange(90))))
    rows += rows[:40]
    got = screen.non_max_suppression(spark.createDataFrame(rows, "key string, x1 double, y1 double, x2 double, y2 double, score double"), "key", threshold, few)
    assert sorted(map(tuple, got.collect()), key=str) == suppressed(rows, threshold)


def test_box_suppression_reads_all_orders(spark, tmp_path):
    orders = [(k, k * 31 % 1000, f"P{k % 2}", float(k * 7919 % 1009)) for k in range(1, 2400, 7)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    boxes = [(p, k % 97, c % 89, k % 97 + 10 + k % 13, c % 89 + 12, t) for k, c, p, t in orders]
    got = QUERIES["box_suppression"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(b[0], *map(float, b[1:])) for b in suppressed(boxes)], key=str)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,timestamps,open,close,high,low,vol,name,industry,block\n21,2020-01-01,1,2,3,0.5,10,n,i,b\n21,bad,1,2,3,0.5,10,n,i,b\n600000,2020-01-02,1,2,3,0.5,10,n,i,b\n")
    (tmp_path / "pool.txt").write_text("# comment\n000021.SZ\n\n")
    pool = sources.read_pool(spark, str(tmp_path / "pool.txt"))
    got = sources.read_csv_bars(spark, str(tmp_path / "a.csv"), "2019-01-01", "2020-12-31", pool).collect()
    assert [(r.code, r.ts) for r in got] == [("000021", DAY)]
    (tmp_path / "index.json").write_text('[["2020-01-01", "1", "4", "3", "2", "9"]]')
    assert sources.read_index_json(spark, str(tmp_path / "index.json")).first().close == 3.0
    (tmp_path / "modes.json").write_text('[{"index": "1", "name": "m", "savedBrushTimeRanges": [{"code": "a", "startDate": "s", "endDate": "e", "saveTime": 1}]}, {"index": "2", "name": "n"}]')
    modes = sources.read_registry(spark, str(tmp_path / "modes.json"))
    assert modes.count() == 2 and sources.add_modes(modes, modes).count() == 2


def test_streamed_bars_equal_static_ones(spark, tmp_path):
    from barline.streaming.bars import hourly

    events = sources.table(spark, "/root/testdata/sf0.001", "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = hourly(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "10000 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.code, r.ts, r.events) for r in df.collect())
    assert key(spark.table("hours")) == key(hourly(events))
