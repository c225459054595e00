"""Symbolic search against plain loops, and a planted formula."""

import math
import random

from barline.operators import symbolic
from barline.operators.learning import readable


def value(tree, row):
    if isinstance(tree, str):
        return row[tree] or 0.0
    if not isinstance(tree, tuple):
        return tree
    name, *cells = tree[0], *[value(a, row) for a in tree[1:]]
    a, b = cells[0], cells[-1]
    return {
        "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a / b if abs(b) > 0.001 else 1.0, "max": lambda: max(a, b), "min": lambda: min(a, b),
        "neg": lambda: -a, "abs": lambda: abs(a), "sqrt": lambda: math.sqrt(abs(a)), "log": lambda: math.log(abs(a)) if abs(a) > 0.001 else 0.0,
    }[name]()


def correlation(xs, ys):
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    xx, yy = sum((x - mx) ** 2 for x in xs), sum((y - my) ** 2 for y in ys)
    return abs(sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True))) / math.sqrt(xx * yy) if xx and yy else 0.0


def data(spark, n=400):
    rng = random.Random(5)
    rows = [{"a": rng.gauss(0, 1), "b": rng.gauss(1, 2), "c.d": rng.gauss(0, 1) if rng.random() < 0.9 else None} for _ in range(n)]
    for r in rows:
        r["y"] = r["a"] * r["b"] - (r["c.d"] or 0.0) if rng.random() < 0.95 else None
    return rows, spark.createDataFrame([(r["a"], r["b"], r["c.d"], r["y"]) for r in rows], "a double, b double, `c.d` double, y double").repartition(5)


NAMES = ["a", "b", "c.d"]


def test_fitness_is_the_plain_correlation(spark):
    rows, df = data(spark)
    trees = symbolic.first(random.Random(1), NAMES, list(symbolic.FUNCTIONS), 120)
    told = [r for r in rows if r["y"] is not None]
    got = symbolic.fitness(symbolic.numbers(df, NAMES, "y"), trees)
    for tree, r in zip(trees, got, strict=True):
        cells = [value(tree, x) for x in told]
        if len(set(cells)) > 1:
            assert math.isclose(r, correlation(cells, [x["y"] for x in told]), abs_tol=1e-7), readable(tree)
        else:
            assert r == 0


def test_planted_formula_is_found_and_repeats(spark):
    rows, df = data(spark)
    found = symbolic.search(df, NAMES, "y", generations=6, population=150, components=4, hall=20, tournament=10)
    assert found[0][1] > 0.97 and len(found) == 4
    again = symbolic.search(df.repartition(2), NAMES, "y", generations=6, population=150, components=4, hall=20, tournament=10)
    assert again == found
    out = symbolic.with_features(df, NAMES, [t for t, _ in found])
    assert out.columns == [*df.columns, *[f"gp_feature_{i}" for i in range(4)]]
    by = {(r["a"], r["b"]): r for r in rows}
    for r in out.collect():
        for i, (tree, _) in enumerate(found):
            assert math.isclose(r[f"gp_feature_{i}"], value(tree, by[r["a"], r["b"]]), rel_tol=1e-9, abs_tol=1e-9)


def test_breeding_keeps_to_its_bounds():
    rng, functions = random.Random(3), list(symbolic.FUNCTIONS)
    trees = symbolic.first(rng, NAMES, functions, 200)
    assert all(symbolic.depth(t) <= 4 for t in trees)
    for _ in range(15):
        old = trees
        trees = [symbolic.child(rng, lambda: rng.choice(old), NAMES, functions, 6) for _ in old]  # noqa: B023
        for t in trees:
            assert symbolic.depth(t) <= 6
            assert all(len(x) - 1 == symbolic.FUNCTIONS[x[0]] if isinstance(x, tuple) else x in NAMES or -1 <= x <= 1 for _, x in symbolic.parts(t))
    assert symbolic.put(("add", "a", ("neg", "b")), (2, 1), 0.5) == ("add", "a", ("neg", 0.5))


def test_nothing_to_find(spark):
    _, df = data(spark, 20)
    few = {"generations": 2, "population": 8, "tournament": 3}
    assert symbolic.search(df.limit(0), NAMES, "y", **few) == []
    assert symbolic.search(df.selectExpr("a", "b", "`c.d`", "1.0 as y"), NAMES, "y", **few) == []
    assert symbolic.fitness(symbolic.numbers(df, NAMES, "y"), []) == []
