"""Exact removal of repeats: that the methods decide, that crowded groups split, and against brute force on odd texts."""

import random
import re

import numpy as np
import pytest

from barline.llm import _repeats, rlz, suffix_array
from barline.llm._text import words

SCHEMA = "doc_id long, text string, n long, spans string"  # clashing names beside


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA).repartition(parts)


def brute(rows, units, length):
    first, split = {}, {d: units(t or "") for d, t in rows if d is not None}
    key = lambda s, i: s[i : i + length] if isinstance(s, bytes) else tuple(s[i : i + length])
    for d in sorted(split):
        for i in range(len(split[d]) - length + 1):
            first.setdefault(key(split[d], i), (d, i))
    out = {}
    for d, s in split.items():
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if first[key(s, i)] != (d, i):
                gone[i : i + length] = [True] * length
        out[d] = len(s), sum(gone), [u for u, g in zip(s, gone, strict=True) if not g]
    return out


def crowded(seed):
    """Copies in part and whole, one passage in most documents, a document that repeats itself, long ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 8))) for _ in range(400)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, whole, long = say(45), say(90), say(6000)
    rows = [(i, f"{say(rng.randint(0, 25))} {passage} {say(rng.randint(0, 25))}") for i in range(0, 300, 2)]
    rows += [(i, whole) for i in range(1, 200, 4)] + [(i, whole.replace(" ", "\n\t", 3)) for i in range(3, 60, 4)]
    rows += [(500, long), (501, long[: len(long) // 2] + say(30) + long[len(long) // 2 :]), (502, "ab" * 700), (503, "x y " * 500), (504, None), (505, ""), (506, "é" * 120), (None, whole)]
    return rows


@pytest.mark.parametrize("hot", [512, 4])
def test_crowded_bytes(spark, hot):
    rows = crowded(1)
    got = {r.doc_id: (r.n, r.n_removed, list(bytes(r.kept))) for r in suffix_array.dedup_bytes(frame(spark, rows), hot=hot).collect()}
    assert got == brute(rows, str.encode, 100)


@pytest.mark.parametrize("hot", [512, 4])
def test_crowded_words(spark, hot):
    rows = crowded(2)
    got = {r.doc_id: (r.n, r.n_removed, bytes(r.kept).decode()) for r in rlz.dedup_words(frame(spark, rows), hot=hot).collect()}
    assert got == {d: (n, g, " ".join(k)) for d, (n, g, k) in brute(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 20).items()}


@pytest.mark.parametrize(("unit", "length", "gram"), [("bytes", 100, 32), ("words", 20, 6)])
@pytest.mark.parametrize("hot", [512, 4])
def test_without_its_method_nothing_is_removed(spark, unit, length, gram, hot):
    none = lambda *a: np.zeros(len(a[1]), bool)
    got = _repeats.remove_repeats(frame(spark, crowded(3)), unit, length, gram, none, none, hot=hot).collect()
    assert got and not any(r.n_removed for r in got)


def test_factors_end_where_words_differ():
    def spans(text):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = words(data, np.array([0, len(data)]))
        return data, starts, ends

    a, b = spans("a b c d e f g h i"), spans("a b c x  e f gg h i")
    got = rlz.factors(*a, *b, np.array([0, 5]), 2)
    assert got.tolist() == [True, True, True, False, False, False, False, True, True]  # the second stretch begins at f, alone


def test_blocks_are_told_apart_by_sorting():
    rng = np.random.default_rng(3)
    source = rng.integers(97, 100, 700).astype(np.uint8)
    copy = source.copy()
    copy[430] ^= 1
    at = np.arange(700)
    got = suffix_array.same_bytes(copy, at, at + 1, source, at, at + 1, np.array([0, 250]), 100)
    assert got[:350].all() and not got[350:450].any() and got[450:].all()  # the string of 100 that holds the other byte


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(97, 99, 300).astype(np.uint8)] * 3)
    places = rng.permutation(len(data) - 40)
    order, slot = suffix_array.multikey_quicksort(suffix_array._words_at(data), places, 13)
    strings = [data[p : p + 13].tobytes() for p in places[order]]
    assert strings == sorted(strings)
    assert all(strings[i] == strings[s] and (s == 0 or strings[s - 1] < strings[s]) for i, s in enumerate(slot))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_array.dedup_texts(none).count() == suffix_array.dedup_bytes(none).count() == rlz.dedup_words(none).count() == 0
