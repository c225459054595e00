"""The rule cascade against plain loops, and its order against all orders."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from barline.llm import queries, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    at = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(at)
    hit = {i + k for i, x in enumerate(at) if n[x] > 1 for k in range(8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_capitals": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
        "n_lines": sum(lines.values()), "n_dup_lines": sum(v - 1 for v in lines.values()), "n_echoes": sum(a == b for a, b in itertools.pairwise(w)), "n_repeat_words": len(hit),
    }


def verdict(f):
    n = f["n_words"]
    base = n < 20 or 100 * f["n_repeat_words"] > 30 * n
    return base, not (base or not 2 * n <= f["word_chars"] <= 15 * n or 4 * f["n_symbols"] > n or 2 * f["n_dup_lines"] > f["n_lines"] or 2 * f["n_capitals"] > f["n_letters"] or 2 * f["n_echoes"] > n)


def texts_of(seed, n=200):
    rng = random.Random(seed)
    parts = ["a", "Bc", "über", "日本語", "#", "|x|", "<b>", "é", "\x00", "\x1c", " ", "word", "WORD", "one two three four five six seven eight nine"]
    gaps = [" "] * 8 + ["\n", "\n", "  ", "\t", "\r\n", "\x0b", "\n\n"]
    out = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    return out + ["", "\n", " \n \n", "\na\na", "a\na\n", "x " * 9, "x " * 8, "x " * 7, ("a b c d e f g h " * 2).strip(), "same line here\n" * 30, "w" * 100_000, "ab " * 50_000]


def texts(some):
    raw = [(t or "").encode() for t in some]
    return rules.Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


@pytest.mark.parametrize("seed", range(4))
def test_features(seed):
    some = texts_of(seed)
    t = texts(some)
    for name, f in rules.FEATURES.items():
        assert f(t).tolist() == [plain(x)[name] for x in some], name
    rows = np.arange(3, len(some), 7)
    for f in rules.FEATURES.values():
        assert f(t.only(rows)).tolist() == f(t)[rows].tolist()


def test_equal_hashes_are_compared(monkeypatch):
    """With one hash for all windows, only those with equal words repeat."""
    some = texts_of(9, 40)[:40]
    monkeypatch.setattr(rules, "runs", lambda h, n: np.zeros(max(len(h) - n + 1, 0), np.uint64))
    assert rules.n_repeat_words(texts(some)).tolist() == [plain(x)["n_repeat_words"] for x in some]


def test_no_order_changes_a_verdict():
    some = texts_of(5, 60)
    t, expected = texts(some), [verdict(plain(x))[1] for x in some]
    for some_order in itertools.islice(itertools.permutations(rules.RULES), 0, 40_320, 997):
        assert (rules.judged(t, list(some_order))[0] < 0).tolist() == expected


def test_order_by_rejection_for_cost():
    """Cheap and selective first; a feature that is paid for costs nothing more; what earlier rules reject counts no more."""
    make = lambda name, *needs: rules.Rule(name, needs, None)
    a, b, c, d = make("a", "x"), make("b", "y"), make("c", "y", "z"), make("d", "x")
    rows = np.arange(100)
    rejected = {"a": rows < 20, "b": rows < 60, "c": rows >= 90, "d": rows < 19}
    got = rules.order((a, b, c, d), rejected, {"x": 1.0, "y": 2.0, "z": 1.0})
    assert [r.name for r in got] == ["b", "c", "a", "d"]  # 30 a unit, 10 a unit, then none is left for a and d


def test_short_circuit():
    """Features of later rules are computed for texts that are still there alone."""
    some = ["few words"] * 90 + [" ".join(f"word{i}" for i in range(50))] * 10
    first, costly = rules.BASE
    by, told, work = rules.judged(texts(some), [first, costly], ())
    assert work == {"n_words": 100, "n_repeat_words": 10} and told == {} and np.count_nonzero(by < 0) == 10
    # Measured on a sample, the rule that takes nearly all texts away and costs less comes before windows.
    assert [r.name for r in rules.measured(some, (costly, first))][0] == "few_words"


def test_cascade_and_keep(spark):
    some = [*texts_of(3), None]
    rows = [(i, x, "a", 1) for i, x in enumerate(some)] + [(0, some[0], "a", 1), (None, "x", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)
    expected = sorted((i, verdict(plain(x))[1], plain(x)["n_words"]) for i, x, *_ in rows if i is not None)
    got = rules.cascade(docs, report=("n_words",)).collect()
    assert sorted((r.doc_id, r.kept, r.n_words) for r in got) == expected
    assert all((r.rejected_by is None) == r.kept for r in got)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i, ok, _ in expected if ok]


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert rules.cascade(none).collect() == [] and rules.keep(none).collect() == []
    assert [r.name for r in rules.measured([], rules.RULES)]


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = sorted(con.execute(queries.ORACLE_SQL["op11_rule_cascade"]).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    loops = []
    for r in docs:
        f = plain(r.text)
        loops.append((r.doc_id, *[f[x] for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], *verdict(f)))
    assert expected == sorted(loops)
    assert sorted(tuple(r) for r in queries.op11_rule_cascade(spark, sf).collect()) == expected


def test_clean_documents_stay(spark):
    """No document of good quality goes by more than the base rules; nearly all others go."""
    sf = "/root/testdata/sf0.01"
    found = queries.op11_rule_cascade(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.kept or r.base_failed for r in found if r.quality == 1)
    bad = [r.kept for r in found if r.quality == 0]
    assert sum(bad) <= 0.02 * len(bad)
