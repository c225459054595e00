"""Collocations against plain counting of every phrase, and against SQL."""

import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from barline.llm import collocations, queries

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=10, longest=3, top=2000, share=(50, 100)):
    """Every phrase counted by itself; integers have no bound here."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang, w] = (a, f[lang, w[:k]], f[lang, w[k:]], score)
    inside = lambda w, v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
    kept = [(lang, w) for lang, w in found if not any(g == lang and len(v) > len(w) and inside(w, v) and share[1] * found[g, v][0] >= share[0] * found[lang, w][0] for g, v in found)]
    out = []
    for lang in {g for g, _ in kept}:
        order = sorted((w for g, w in kept if g == lang), key=lambda w: (-found[lang, w][3], -found[lang, w][0], " ".join(w).encode()))
        out += [(lang, i + 1, " ".join(w), *found[lang, w][:3], n[lang], found[lang, w][3]) for i, w in enumerate(order[:top])]
    return sorted(out)


def rows_of(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "c", "über", "É", "the", "of", "x-y", "日本", "#", "\x00", " ", "\x1c", "it's"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", ";", ":", "!", "?"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rows = rows_of(seed) + [("en", None), ("en", ""), ("fr", " . \n"), (None, "word"), ("xx", "one two three. " * 40)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    got = collocations.collocations(docs, top=50)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, top=50)


def test_narrow_sketch_loses_nothing(spark, monkeypatch):
    """Where nearly all rare phrases survive the sketch, the result is the same; so it is with parts of a few bytes."""
    rows = rows_of(7)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    expected = plain(rows, least=4, longest=4)
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 4, 4, most_bits=6).collect()) == expected
    words = collocations.counts(docs, 4, 1, most_bits=6).where("size = 0")
    assert {r.lang: r.n for r in words.collect()} == {r[0]: r[6] for r in expected}


def test_counters_never_fall_short():
    rng = np.random.default_rng(1)
    row, truth = np.zeros(64, np.uint8), np.zeros(64, np.int64)
    for _ in range(30):
        at = rng.integers(0, 64, 500).astype(np.uint32)
        collocations.count(row, at, 100)
        truth += np.bincount(at, minlength=64)
    assert (row == np.minimum(truth, 100)).all()
    pack = pa.Codec("zstd", 1).compress
    batches = [pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([pack(bytes([k, 9, 100]), asbytes=True)], pa.binary())], names=["block", "counters"]) for k in (1, 4, 5)]
    (merged,) = list(collocations._merge(iter(batches), 3, 10))
    assert merged["bits"].to_pylist() == [np.packbits([True, True, True]).tobytes()]


@pytest.mark.parametrize("least", [1, 10, 15])
def test_two_counters_in_a_byte(least):
    rng = np.random.default_rng(2)
    row, packed = np.zeros(64, np.uint8), np.zeros(32, np.uint8)
    for n in (0, 1, 5, 40, 200, 5000):
        at = rng.integers(0, 64, n).astype(np.uint32)
        collocations.count(row, at, least)
        collocations.count_packed(packed, at, least)
        for first, end in ((0, 64), (0, 16), (16, 48), (32, 64), (48, 64)):
            assert (collocations.unpacked(packed, first, end) == row[first:end]).all()


def test_counters_of_a_byte(spark):
    rows = rows_of(5, 600)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert sorted(tuple(r) for r in collocations.collocations(docs, 16).collect()) == plain(rows, least=16) != []


def test_hashes_of_words_in_parts(monkeypatch):
    """Equal words have equal hashes, wherever they stand and however many are hashed at once."""
    texts = [b"a bb a", b"", b" ccc" * 30, b"x" * 100, b"bb a"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = collocations.Words(data, offsets, 3).hashes()
    for n in (1, 7, 64):
        monkeypatch.setattr(collocations, "HASHED", n)
        assert (collocations.Words(data, offsets, 3).hashes() == whole).all()
    assert len(whole) == 36 and len(set(whole.tolist())) == 4


@pytest.mark.parametrize("step", ["sketch", "exact"])
def test_memory_of_a_task(step):
    """Beside the text a task holds its sketch and what a part of the text needs, a few hundredths of an executor."""
    rng = np.random.default_rng(3)
    rows = [" ".join(f"w{i}" for i in rng.zipf(1.3, 20_000) % 10_000) for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array(rows)], names=["lang", "text"])
    assert batch.nbytes > 6_000_000
    tracemalloc.start()
    try:
        out = collocations._sketch(iter([batch]), 22, 10, 3) if step == "sketch" else collocations._exact(iter([batch]), (22, np.full(collocations.ROWS << 22 >> 3, 255, np.uint8)), 3)
        assert sum(x.num_rows for x in out)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < (50 if step == "sketch" else 160) * 1e6


def test_sketch_thins_out(spark):
    """Of phrases that occur once nearly none survive."""
    rows = [("en", " ".join(f"w{i}x{j}" for j in range(200))) for i in range(200)]
    bits, raw = collocations.survivors(spark.createDataFrame(rows, "lang string, text string"), 10, 3)
    assert np.unpackbits(np.frombuffer(raw, np.uint8)).mean() < 0.01


def test_scores_beyond_64_bits(spark):
    n = 3_000_000_000
    found = spark.createDataFrame([("en", 1, "a", n), ("en", 1, "b", n + 7), ("en", 2, "a b", n - 5), ("en", 0, "", 9 * n)], "lang string, size int, phrase string, n long")
    (r,) = collocations.scored(found).collect()
    assert (r.l, r.r, r.score) == (n, n + 7, 1_000_000 * (n - 5) ** 2 // (n * (n + 7)))


def test_hot_parts(spark, monkeypatch):
    """Counts of parts that many phrases share are broadcast, with the same result."""
    rows = [("en", f"the w{i}. w{i} the. " * 10) for i in range(60)] + [("en", "the the the. " * 10)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    expected = plain(rows)
    for hot in (1, 5, 1_000_000):
        monkeypatch.setattr(collocations, "HOT", hot)
        assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == expected


def test_odd_tables(spark):
    none = spark.createDataFrame([], "text string, lang string, phrase int, n int")
    assert collocations.collocations(none).collect() == []
    same = spark.createDataFrame([("A b", 1, "x")] * 10, "text string, lang int, n string")
    assert [tuple(r) for r in collocations.collocations(same).collect()] == [("1", 1, "a b", 10, 10, 10, 20, 1_000_000)]


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.execute(queries.ORACLE_SQL["op12_collocations"]).fetchall()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()
    assert sorted(expected) == plain([tuple(r) for r in docs])
    assert sorted(tuple(r) for r in queries.op12_collocations(spark, sf).collect()) == sorted(expected)
