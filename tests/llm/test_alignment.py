"""Cross-tokenizer alignment against whole texts encoded and aligned token by token."""

import hashlib
import random
from collections import Counter

import pytest

from barline.llm import alignment, queries

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain(rows):
    """The contract's columns, from the tokenizers' own ids of whole texts."""
    p = alignment.pair(A, B)
    told = []
    for doc, text in rows:
        a, b = ([], []) if not text else (p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text))
        bytes_a, bytes_b = [p.side_a.raw[i] for i in a], [p.side_b.raw[i] for i in b]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            a, b, bytes_a, bytes_b = [], [], [], []
        groups, links, i, j, x, y, own = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if x <= y and i < len(a):
                own[0].append(a[i])
                x, i = x + len(bytes_a[i]), i + 1
            else:
                own[1].append(b[j])
                y, j = y + len(bytes_b[j]), j + 1
            if x == y and own[0] and own[1]:
                groups.append(own)
                links.append((own[0][-1], own[1][-1]))
                own = ([], [])
        assert own == ([], [])
        told.append((doc, len(a), len(b), groups, links))
    counts = Counter(link for t in told for link in t[4])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return counts, [
        (doc, n_a, n_b, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join("|".join(",".join(map(str, side)) for side in group) for group in g))
        for doc, n_a, n_b, g, links in told
    ]


PARTS = ["the", "The", " ", "  ", "   ", "\n", "\n\n", " \n", "\t", "\r\n", "é", "à ", "naïve", "ß", "日本", "語 ", "🙂", " ", " ", "　", "\u0085", "​", "\x00", "\x1c", "'s", "don't", "1234", "a1b", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "...", "$$$", "﻿", "é"]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "x "), (1004, "a ▁ b"), (1005, "▁"), (3, "the the"), (3, "the the"), (1006, "  x  "), (1007, "long" * 5000 + " " + "x " * 4000)]
    counts, expected = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert sorted(got) == sorted(expected)
    assert {(r.a_id, r.b_id): r["count"] for r in alignment.pair_counts(docs).collect()} == dict(counts)


def test_small_parts_and_shards(spark, monkeypatch):
    """Parts of a few bytes and shards of a few pairs give the same result, and shards are sorted."""
    rows = [(i, f"some words of text no. {i}, and {i % 7} more!\nA line") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, expected = plain(rows)
    monkeypatch.setattr(alignment, "SHARD", 7)
    shards = alignment.Shards.write(alignment.packed_counts(docs), alignment.most_pairs(A, B), 32000)
    mapped, best = shards.open()
    keys = [k for m in mapped for k in m[0].tolist()]
    assert len(mapped) == -(-len(counts) // 7) and keys == sorted(counts_key(c) for c in counts)
    assert best[next(iter(counts))[1]] >= 1
    assert sorted(tuple(r) for r in alignment.align(docs).collect()) == sorted(expected)


def counts_key(link):
    return link[1] << 32 | link[0]


def test_parts_do_not_matter():
    import numpy as np

    data = " a b\n  c  d é f　 g".encode()
    found, which, edges = alignment.stretches(np.frombuffer(data, np.uint8), np.array([0, len(data), len(data)]))
    assert b"".join(found[i] for i in which) == b" " + data and edges.tolist() == [0, len(which), len(which)]


def test_run_lengths_across_batches():
    import pyarrow as pa

    keys = [[1, 1, 2], [2, 2], [], [2, 3], [4]]
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([1] * len(k), pa.int64())], names=["pair", "count"]) for k in keys]
    got = [(k, n) for x in alignment._run_lengths(iter(batches)) for k, n in zip(x["pair"].to_pylist(), x["count"].to_pylist(), strict=True)]
    assert got == [(1, 2), (2, 4), (3, 1), (4, 1)]


def test_bound_of_pairs():
    """The bound that the README states."""
    assert alignment.most_pairs(A, B) == 324_297


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, groups int, pair int")
    assert alignment.align(none).collect() == [] and alignment.pair_counts(none).collect() == []
    odd = spark.createDataFrame([(None, "x", 1), (1, None, 2)], "doc_id long, text string, n_a int")
    assert [tuple(r) for r in alignment.align(odd).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = [(*x[:7], hashlib.sha256(x[7].encode()).hexdigest() if x[7] else "") for x in plain(rows)[1]]
    assert sorted(tuple(r) for r in queries.op13_alignment(spark, sf).collect()) == sorted(expected)
