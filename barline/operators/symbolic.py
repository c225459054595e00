"""Symbolic feature search: expression trees bred towards correlation with a target.

Trees are those of `learning.expression`. The driver holds the population, which a parameter bounds, and breeds it from one seeded generator;
Spark scores all new trees of a generation in one pass over the rows, of which a task leaves one row a tree. (As columns of one
plan hundreds of trees are more code than the engine compiles, so tasks evaluate them over Arrow batches.)
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.operators.learning import expression, readable
from barline.sources.store import cut

Tree = tuple | str | float

#: Functions that a search may use, and how many arguments each takes.
FUNCTIONS = {"add": 2, "sub": 2, "mul": 2, "div": 2, "sqrt": 1, "log": 1, "abs": 1, "neg": 1, "max": 2, "min": 2}

#: Shares of the ways in which a child comes about; the rest are copies of a parent.
CROSSED, REGROWN, HOISTED, CHANGED = 0.9, 0.02, 0.02, 0.02

#: The share of nodes that a change by points replaces.
POINTS = 0.05

#: A tree whose values deviate by no more than this share of the largest is taken for a constant: what is left is rounding.
STILL = 1e-9


def parts(tree: Tree, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Tree]]:
    """Every subtree with its path of argument numbers, the whole first."""
    yield path, tree
    if isinstance(tree, tuple):
        for i, argument in enumerate(tree[1:], 1):
            yield from parts(argument, (*path, i))


def size(tree: Tree) -> int:
    return sum(1 for _ in parts(tree))


def depth(tree: Tree) -> int:
    return max(len(path) for path, _ in parts(tree))


def put(tree: Tree, path: tuple[int, ...], new: Tree) -> Tree:
    """The tree with another subtree at the path."""
    if not path:
        return new
    return (*tree[: path[0]], put(tree[path[0]], path[1:], new), *tree[path[0] + 1 :])


def renamed(tree: Tree, name: Callable[[str], str]) -> Tree:
    """The tree with other column names."""
    if isinstance(tree, tuple):
        return (tree[0], *[renamed(a, name) for a in tree[1:]])
    return name(tree) if isinstance(tree, str) else tree


def leaf(rng: random.Random, names: list[str]) -> Tree:
    """A name or, as likely as each name, a number from -1 to 1."""
    place = rng.randrange(len(names) + 1)
    return names[place] if place < len(names) else round(rng.uniform(-1, 1), 3)


def grown(rng: random.Random, names: list[str], functions: list[str], deep: int, full: bool) -> Tree:
    """A random tree at most `deep` functions deep; in a full one every leaf is as deep."""
    if deep == 0 or not full and rng.random() * (len(names) + len(functions)) < len(names):
        return leaf(rng, names)
    name = rng.choice(functions)
    return (name, *[grown(rng, names, functions, deep - 1, full) for _ in range(FUNCTIONS[name])])


def first(rng: random.Random, names: list[str], functions: list[str], population: int, deepest: int = 4) -> list[Tree]:
    """Trees of a first generation: half of them full, at depths from 2 on."""
    return [grown(rng, names, functions, rng.randint(min(2, deepest), deepest), i % 2 == 0) for i in range(population)]


def child(rng: random.Random, pick: Callable[[], Tree], names: list[str], functions: list[str], deepest: int) -> Tree:
    """A parent changed in one way; the parent itself where the change would be deeper than `deepest`."""
    parent, way = pick(), rng.random()
    path, old = rng.choice(list(parts(parent)))
    if way < CROSSED:
        new = put(parent, path, rng.choice(list(parts(pick())))[1])
    elif way < CROSSED + REGROWN:
        new = put(parent, path, grown(rng, names, functions, 2, False))
    elif way < CROSSED + REGROWN + HOISTED:
        new = put(parent, path, rng.choice(list(parts(old)))[1])
    elif way < CROSSED + REGROWN + HOISTED + CHANGED:
        new = _pointed(rng, parent, names, functions)
    else:
        new = parent
    return new if depth(new) <= deepest else parent


def _pointed(rng: random.Random, tree: Tree, names: list[str], functions: list[str]) -> Tree:
    other = rng.random() < POINTS
    if not isinstance(tree, tuple):
        return leaf(rng, names) if other else tree
    alike = [f for f in functions if FUNCTIONS[f] == len(tree) - 1]
    return (rng.choice(alike) if other else tree[0], *[_pointed(rng, a, names, functions) for a in tree[1:]])


def _own(name: str) -> str:
    """A column's name without dots, which batches don't take."""
    return "_f_" + name.replace("_", "__").replace(".", "_d")


def _filled(names: list[str]) -> list[Column]:
    """The features as doubles under names of their own; missing values are 0."""
    return [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(_own(c)) for c in names]


def _cell(tree: Tree) -> Column:
    return expression(renamed(tree, _own))


def numbers(rows: DataFrame, names: list[str], target: str) -> DataFrame:
    """The target as `_y` and the features as doubles, missing values as 0; rows without a target leave."""
    return rows.select(F.col(f"`{target}`").cast("double").alias("_y"), *_filled(names)).where("_y is not null")


def values(tree: Tree, cells: pd.DataFrame) -> np.ndarray:
    """What `expression` gives, over the columns of a batch."""
    if not isinstance(tree, tuple):
        return cells[_own(tree)].to_numpy() if isinstance(tree, str) else np.full(len(cells), float(tree))
    name, *arguments = tree
    a, *more = (values(x, cells) for x in arguments)
    if name in ("sqrt", "log", "abs"):
        a = np.abs(a)
    if name == "log":
        return np.log(a, out=np.zeros_like(a), where=~(a <= 0.001))
    if name == "div":
        return np.divide(a, more[0], out=np.ones_like(a), where=~(np.abs(more[0]) <= 0.001))
    plain = {"add": np.add, "sub": np.subtract, "mul": np.multiply, "max": np.maximum, "min": np.fmin, "sqrt": np.sqrt, "neg": np.negative, "abs": np.abs}
    return plain[name](a, *more)


MOMENTS = "_tree int, n long, x double, y double, xx double, xy double, yy double, most double"


def _moments(trees: list[Tree]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each tree, of all rows of a task: their number, means, sums of squared and crossed deviations, and the largest size of a value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, y, yy = 0, 0.0, 0.0
        x, xx, xy, most = np.zeros((4, len(trees)))
        with np.errstate(all="ignore"):
            for batch in batches:
                k = len(batch)
                if not k:
                    continue
                own_y = batch["_y"].to_numpy()
                dy = own_y - own_y.mean()
                own = np.empty((4, len(trees)))
                for i, tree in enumerate(trees):
                    v = values(tree, batch)
                    # The middle of a batch that doesn't vary is its value, without rounding.
                    mean = v[0] + (v - v[0]).mean()
                    dx = v - mean
                    own[:, i] = mean, dx @ dx, dx @ dy, np.abs(v).max()
                shift, shift_y, weight = own[0] - x, own_y.mean() - y, n * k / (n + k)
                xx, xy, yy = xx + own[1] + shift * shift * weight, xy + own[2] + shift * shift_y * weight, yy + dy @ dy + shift_y * shift_y * weight
                n, x, y, most = n + k, x + shift * (k / (n + k)), y + shift_y * (k / (n + k)), np.maximum(most, own[3])
        if n:
            yield pd.DataFrame({"_tree": np.arange(len(trees), dtype=np.int32), "n": n, "x": x, "y": y, "xx": xx, "xy": xy, "yy": yy, "most": most})

    return run


def fitness(told: DataFrame, trees: list[Tree]) -> list[float]:
    """The size of each tree's correlation with the target over the rows of `numbers`, to 9 digits; 0 where there is none.

    One pass over the rows: each task leaves one row a tree, and tasks' rows meet by tree. Digits beyond those depend on the order in which they
    meet, so a search doesn't see them.
    """
    if not trees:
        return []
    by = Window.partitionBy("_tree")
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(by) / F.sum("n").over(by)
    parts_ = told.mapInPandas(_moments(trees), MOMENTS).withColumns({"_x": F.col("x") - mean("x"), "_y": F.col("y") - mean("y")})
    whole = parts_.groupBy("_tree").agg(*[F.sum(F.col(c + d) + F.col("n") * F.col(f"_{c}") * F.col(f"_{d}")).alias(c + d) for c, d in ("xx", "xy", "yy")], F.sum("n").alias("n"), F.max("most").alias("most"))
    varies = F.sqrt(F.col("xx") / F.col("n")) > STILL * F.col("most")
    r = F.when(varies, F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))
    found = {row["_tree"]: row["r"] for row in whole.select("_tree", r.alias("r")).collect()}  # one row a tree
    sizes = [found.get(i) for i in range(len(trees))]
    return [0.0 if r is None or not math.isfinite(r) else round(abs(r), 9) for r in sizes]


def unlike(told: DataFrame, trees: list[Tree], components: int) -> list[Tree]:
    """Of trees in order of merit those that stay when, again and again, the worse of the two most correlated leaves."""
    if len(trees) <= components:
        return trees
    vectors = told.select(array_to_vector(F.array(*map(_cell, trees))).alias("v"))
    table = Correlation.corr(vectors, "v").first()[0].toArray()
    left = list(range(len(trees)))
    while len(left) > components:
        pairs = ((round(abs(table[a, b]), 9) if math.isfinite(table[a, b]) else 0.0, b) for i, a in enumerate(left) for b in left[i + 1 :])
        left.remove(max(pairs)[1])
    return [trees[i] for i in left]


def search(
    rows: DataFrame, names: list[str], target: str, generations: int = 10, population: int = 1000, components: int = 10, hall: int = 100,
    functions: tuple[str, ...] = tuple(FUNCTIONS), tournament: int = 20, parsimony: float = 0.001, deepest: int = 8, seed: int = 42,
) -> list[tuple[Tree, float]]:
    """Trees whose values go with the target, best first, and the size of each one's correlation with it over all rows.

    A parent is the best of `tournament` trees drawn, where each node of a tree costs `parsimony`. Of the last generation's `hall` best trees
    `components` that are least alike stay. A search repeats by its seed. Missing features are 0; rows without a target
    don't count. Without rows, or where the target doesn't vary, no tree is found.
    """
    rng, functions, known = random.Random(seed), list(functions), {}
    told = cut(numbers(rows, names, target))
    trees = first(rng, names, functions, population)
    for generation in range(generations):
        if generation:
            ranked = {t: (known[t] - parsimony * size(t), -size(t), readable(t)) for t in trees}
            parents = trees

            def pick() -> Tree:
                return max((rng.choice(parents) for _ in range(tournament)), key=ranked.__getitem__)  # noqa: B023

            trees = [child(rng, pick, names, functions, deepest) for _ in parents]
        new = [t for t in dict.fromkeys(trees) if t not in known]
        known.update(zip(new, fitness(told, new), strict=True))
    best = sorted((t for t in dict.fromkeys(trees) if known[t] > 0), key=lambda t: (-known[t], size(t), readable(t)))
    return [(t, known[t]) for t in unlike(told, best[:hall], components)]


def with_features(rows: DataFrame, names: list[str], trees: list[Tree], prefix: str = "gp_feature_") -> DataFrame:
    """rows with each tree's value as a column of its own; missing features are 0, as in the search."""
    return rows.select("*", *_filled(names)).withColumns({f"{prefix}{i}": _cell(t) for i, t in enumerate(trees)}).drop(*map(_own, names))
