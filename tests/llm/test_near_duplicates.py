"""Near-duplicate groups against an exact join, on families that crowd one region."""

import random
from collections import defaultdict

import numpy as np
import pytest

from barline.llm import lsh_forest

SCHEMA = "doc_id long, text string, n long, component_id string"  # clashing names beside


def exact(rows, shingle, share):
    """{id: smallest id that links reach}, by comparing all sets."""
    ids = sorted(d for d, _ in rows if d is not None)
    text = dict(rows)
    columns, sizes = defaultdict(list), []
    for i, d in enumerate(ids):
        w = (text[d] or "").lower().split()
        own = {tuple(w[j : j + shingle]) for j in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        sizes.append(len(own))
        for s in own:
            columns[s].append(i)
    held = np.zeros((len(ids), sum(len(c) > 1 for c in columns.values())), np.float32)
    for j, c in enumerate(c for c in columns.values() if len(c) > 1):
        held[c, j] = 1
    both, n = held @ held.T, np.array(sizes)
    a, b = np.nonzero(np.triu((both > 0) & (100 * both >= share * (n[:, None] + n[None] - both)), 1))
    root = lsh_forest.union(len(ids), a, b)
    return {d: ids[root[i]] for i, d in enumerate(ids)}


def family(rng, n, words, low, high):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(low, high)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


def check(spark, rows, shingle, share, **sizes):
    got = lsh_forest.components(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4), shingle, (share, 100), **sizes).collect()
    assert {r.doc_id: r.component_id for r in got} == exact(rows, shingle, share)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 256}, {"full": 0, "chunk": 700}])
def test_family_without_its_original(spark, sizes):
    rows = list(enumerate(family(random.Random(1), 2000, 150, 3, 7)))
    assert len(set(exact(rows, 3, 85).values())) > 1000  # near the bound: most are apart, hundreds are linked
    check(spark, rows, 3, 85, **sizes)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 64}])
def test_chains_mixed_sizes_and_crowds(spark, sizes):
    rng = random.Random(2)
    texts = [t for size, words, low, high in [(300, 100, 2, 4), (80, 12, 0, 1), (60, 400, 1, 30), (150, 6, 0, 2)] for t in family(rng, size, words, low, high)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(0, 190, 4):  # each is linked with the next alone
        texts.append(" ".join(chain))
        chain[i : i + 4] = [f"d{i + j}" for j in range(4)]
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [f"{shared} " + " ".join(f"u{k}x{i}" for i in range(rng.randrange(40, 200))) for k in range(300)]  # a passage that many share
    texts += ["", None, "one", "One", "two words", "a b c", "A B C", texts[0], texts[0].upper(), " ".join(f"l{i}" for i in range(30_000)), " ".join(f"l{i}" for i in range(30_100))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    check(spark, [(i, texts[k]) for i, k in enumerate(order)], 3, 85, **sizes)


def test_pipeline_bound(spark):
    rng = random.Random(3)
    texts = [t for _ in range(30) for t in family(rng, 20, rng.randrange(20, 200), 0, 6)]
    check(spark, list(enumerate(texts)), 5, 80)


def test_rows_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (3, b), (5, b), (5, c), (7, c), (7, c), (None, a), (9, a)]
    got = lsh_forest.components(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA), 3, (85, 100)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (9, 3)]


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 80)).astype(np.uint64)) for _ in range(60)]
    got = lsh_forest.overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for j in range(60) for i in range(j))
