"""Scans in blocks against windows by code and plain loops."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from barline.operators import blocks, stages

DAY = datetime.date(2020, 1, 1)


def series(spark, seed, n=400):
    """Walks with rises that last for many blocks."""
    rng, rows = random.Random(seed), []
    for c, steps in (("a", (-200, -100, 100, 200, 300)), ("b", (100, 101, 102)), ("c", (-100, 150)), ("d", (0,))):
        close = 1_000_000
        for i in range(n if c != "d" else 60):
            close += rng.choice(steps) + (5 * (i % 90) if c == "c" else 0) - (400 if c == "b" and i % 120 > 110 else 0)
            rows.append((c, DAY + datetime.timedelta(days=i * (1 + i % 2)), close))
    rows += [("short", DAY, 5), ("short", DAY + datetime.timedelta(days=1), 6)]
    return spark.createDataFrame(sorted(set(rows)), "code string, ts date, close long").dropDuplicates(["code", "ts"])


@pytest.mark.parametrize(("seed", "block"), [(1, 1), (1, 7), (2, 50), (3, 1 << 16)])
def test_equal_to_windows_by_code(spark, seed, block):
    bars = series(spark, seed).cache()
    sums = stages.rolling_sums(bars)
    rows = lambda df: sorted(map(tuple, df.collect()))
    own = blocks.rolling_sums(bars, block=block)
    assert rows(own.select("code", "ts", "n", "s4", "s20", "s47")) == rows(sums.select("code", "ts", "n", "s4", "s20", "s47"))
    found = rows(stages.stage_positions(sums))
    assert len({x[1] for x in found}) >= 3
    assert rows(blocks.stage_positions(bars, block=block)) == found
    assert rows(blocks.bullish_runs(bars, block=block)) == rows(stages.bullish_runs(sums))


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
def test_runs_against_a_loop(spark, block):
    rng, rows = random.Random(block), []
    for code in range(12):
        share = (0.2, 0.5, 0.9, 0.99, 1.0, 0.0)[code % 6]
        rows += [(str(code), i, rng.random() < share, rng.random() < 0.1, rng.random() < 0.1, rng.randrange(1000)) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "code string, n long, f boolean, x boolean, y boolean, v int").withColumn("block", F.expr(f"n div {block}"))
    got = blocks.runs(df, F.col("f"), {"xb": F.col("x")}, {"ya": F.col("y")}, {"yf": F.col("y")}, {"va": F.col("v")}, {"vb": F.col("v")})
    expected = []
    for code in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == code]
        i = 0
        while i < len(own):
            if own[i][2]:
                a = i
                while i + 1 < len(own) and own[i + 1][2]:
                    i += 1
                first = lambda k, start: next((j for j in range(start, len(own)) if own[j][k]), None)  # noqa: B023, E731
                expected.append((code, a, i, len(own) - 1, max((j for j in range(a) if own[j][3]), default=None), first(4, a), own[a][5], first(4, i + 1), own[i][5]))
            i += 1
    got = got.select("code", "a", "b", "last_n", "xb", "yf", "va", "ya", "vb")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


def test_numbers_and_totals_of_timestamps(spark):
    start, rng, rows = datetime.datetime(2024, 1, 1), random.Random(5), []
    for code in ("x", "y"):
        rows += [(code, start + datetime.timedelta(hours=rng.randrange(300)), i, rng.randrange(-50, 50)) for i in range(200)]
    df = spark.createDataFrame(rows, "code string, ts timestamp, id long, v int")
    got = blocks.numbered(df, {"sum": F.col("v")}, ("ts", "id"), 16).collect()
    for code in ("x", "y"):
        own, total = sorted(r for r in rows if r[0] == code), 0
        by = {r.id: r for r in got if r.code == code}
        for n, r in enumerate(own):
            total += r[3]
            assert (by[r[2]].n, by[r[2]].block, by[r[2]]["sum"]) == (n, n // 16, total)


def test_bars_around_a_block(spark):
    df = spark.createDataFrame([("x", i) for i in range(20)], "code string, n long").withColumn("block", F.expr("n div 4"))
    got = blocks.around(df, 6, 1, 4).groupBy("block").agg(F.array_sort(F.collect_list("n")).alias("all"), F.count_if("own").alias("own")).collect()
    for r in got:
        lo, hi = r.block * 4, r.block * 4 + 4
        assert r["all"] == [n for n in range(20) if lo - 6 <= n < hi + 1] and r.own == sum(lo <= n < hi for n in range(20))


def test_empty(spark):
    none = spark.createDataFrame([], "code string, ts date, close long")
    assert blocks.stage_positions(none).collect() == [] and blocks.bullish_runs(none).collect() == [] and blocks.rolling_sums(none).collect() == []


def test_one_code_in_many_tasks(spark):
    """No exchange of bars is by the code alone: with one code, bars of a step lie in many partitions."""
    n, block = 40_000, 1000
    bars = spark.range(n).select(F.lit("x").alias("code"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), (1_000_000 + F.col("id") * 3 + (F.xxhash64("id") % 50)).alias("close"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marked = blocks.marked_bars(bars, block=block)
        held = [r["count"] for r in marked.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("count"), F.sum("s47"), F.count_if("qualified")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(held) == 4 and max(held) < 0.5 * n
    assert sorted(map(tuple, blocks.stage_positions(bars, block=block).collect())) == sorted(map(tuple, stages.stage_positions(stages.rolling_sums(bars)).collect()))


def long_block(spark, n=30_000):
    """Bars of one code that fill one block: rises and falls, each some dozens of bars long."""
    return spark.range(n).select(F.lit("x").alias("code"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (1_000_000 + F.abs(F.col("id") % 200 - 100) * 30 + (F.xxhash64("id") % 40)).alias("close"))


def frames_summed_anew(df):
    """Window frames that begin at a row and have no end: each of their rows costs all rows behind it."""
    return re.findall(r"specifiedwindowframe\(RowFrame, (?!unboundedpreceding)\S+, unboundedfollowing", df._jdf.queryExecution().optimizedPlan().toString())


def test_bullish_runs_of_a_full_block(spark):
    bars = long_block(spark)
    found = blocks.bullish_runs(bars)
    assert not frames_summed_anew(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, blocks.bullish_runs(bars, block=500).collect())) != []


def test_stages_of_a_full_block(spark):
    bars = long_block(spark)
    found = blocks.stage_positions(bars)
    assert not frames_summed_anew(found)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, blocks.stage_positions(bars, block=500).collect())) and {r[1] for r in rows} >= {"stage1", "stage2", "all"}
