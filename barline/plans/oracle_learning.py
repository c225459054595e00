"""DuckDB SQL of the queries that fit models: features of each segment's bars, normal naive Bayes for each stage and duration type, votes."""

from __future__ import annotations

from barline.operators.learning import SMOOTH, readable
from barline.operators.symbolic import STILL
from barline.plans import oracle
from barline.plans.queries import FEATURES, POPULATION

_KEY = "concat_ws('|', code, stage, lo, hi)"
_PART = f"CASE WHEN CAST('0x' || substr(md5(concat_ws('|', code, stage, lo, '42')), 1, 7) AS BIGINT) < CAST(floor(0.7 * 268435456) AS BIGINT) THEN 'train' ELSE 'test' END"
_TABLES = oracle.changed(
    "lagged",
    {
        "parted": f'SELECT {_KEY} AS key, code AS own, stage, lo, hi, start, "end", duration_type, {_PART} AS part FROM features',
        "grouped": 'SELECT m.* EXCLUDE (code), p.key AS code FROM parted p JOIN sums m ON m.code = p.own AND m.ts BETWEEN p.start - 50 AND p."end"',
    },
    lagged=oracle.TABLES["lagged"].replace(" FROM sums ", " FROM grouped "),
) | {
    "cells": "SELECT code AS key, ts, n, " + ", ".join(f"CAST({oracle.LAST_CELLS[c]} AS DOUBLE) AS {c}" for c in FEATURES) + " FROM lagged",
    "ahead": "SELECT code, n, close, lead(close, 5) OVER (PARTITION BY code ORDER BY ts) AS later FROM sums",
    "rows_": "SELECT p.*, c.* EXCLUDE (key), CASE WHEN a.later IS NOT NULL THEN CAST(a.later > a.close AS INTEGER) END AS label FROM parted p JOIN cells c ON c.key = p.key AND c.ts >= p.start JOIN ahead a ON a.code = p.own AND a.n = c.n",
    "classes": "SELECT stage, duration_type, label, count(*) AS rows, " + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + {SMOOTH!r} AS v_{c}" for c in FEATURES) + " FROM rows_ WHERE part = 'train' AND label IS NOT NULL GROUP BY stage, duration_type, label",
    "scores": "SELECT r.key, r.n, k.label, ln(k.rows / (SELECT sum(rows) FROM classes x WHERE x.stage = k.stage AND x.duration_type = k.duration_type))"
    + "".join(f" - 0.5 * ln(2 * pi() * v_{c}) - (r.{c} - m_{c}) ** 2 / (2 * v_{c})" for c in FEATURES)
    + " AS score FROM rows_ r JOIN classes k ON k.stage = r.stage AND k.duration_type = r.duration_type",
    "told": "SELECT key, n, 1 / (1 + exp(greatest(-700, least(700, max(CASE WHEN label = 0 THEN score END) - max(CASE WHEN label = 1 THEN score END))))) AS up FROM scores GROUP BY key, n HAVING count(*) = 2",
    "votes": "SELECT key, avg(up) AS up, avg(CAST(up > 0.5 AS INTEGER)) AS share FROM told GROUP BY key",
}

_BARS = oracle.TABLES | {
    "cells": "SELECT code, ts, n, close, " + ", ".join(f"coalesce(CAST({oracle.LAST_CELLS[c]} AS DOUBLE), 0.0) AS {c}" for c in FEATURES) + " FROM lagged",
    "ahead": f"SELECT *, CAST(lead(close, 5) OVER (PARTITION BY code ORDER BY ts) AS DOUBLE) / close - 1 AS ahead, {_PART.replace('stage, lo', 'ts')} AS part FROM cells",
}


def formula(tree: tuple | str | float) -> str:
    """An expression tree as SQL."""
    if not isinstance(tree, tuple):
        return tree if isinstance(tree, str) else f"CAST({tree!r} AS DOUBLE)"
    name, (a, *b) = tree[0], [formula(x) for x in tree[1:]]
    return {
        "add": "({a} + {b})", "sub": "({a} - {b})", "mul": "({a} * {b})", "div": "CASE WHEN abs({b}) > 0.001 THEN {a} / {b} ELSE 1.0 END", "max": "greatest({a}, {b})", "min": "least({a}, {b})",
        "neg": "(-{a})", "abs": "abs({a})", "sqrt": "sqrt(abs({a}))", "log": "CASE WHEN abs({a}) > 0.001 THEN ln(abs({a})) ELSE 0.0 END",
    }[name].format(a=a, b=b[0] if b else "")


def _scored(place: int, tree: tuple | str | float) -> str:
    moments = f"stddev_pop(x) > {STILL!r} * max(abs(x))"
    return f"SELECT {place} AS place, '{readable(tree)}' AS feature, CASE WHEN {moments} THEN abs(covar_pop(x, ahead) / (stddev_pop(x) * stddev_pop(ahead))) ELSE 0.0 END AS fitness FROM (SELECT {formula(tree)} AS x, ahead FROM train)"


ORACLE_SQL = {
    "symbolic_fitness": oracle.sql(
        "SELECT CAST(place AS INTEGER) AS place, feature, round(fitness, 6) AS fitness FROM (" + " UNION ALL ".join(_scored(i, t) for i, t in enumerate(POPULATION)) + ")",
        tables=_BARS | {"train": "SELECT * FROM ahead WHERE ahead IS NOT NULL AND part = 'train'"},
    ),
    "segments_with_probabilities": oracle.sql(
        "SELECT own AS code, stage, lo, hi, duration_type, CASE WHEN up IS NULL OR part = 'train' THEN 0 ELSE 2 END AS classes, round(CASE WHEN up IS NULL OR part = 'train' THEN 0.0 ELSE up END, 4) AS class2 FROM parted LEFT JOIN votes USING (key)",
        tables=_TABLES,
    ),
    "segment_votes": oracle.sql("SELECT own AS code, stage, lo, hi, CASE WHEN share > 0.5 THEN 'long' ELSE 'short' END AS kind, round(up, 4) AS up, round(1 - up, 4) AS down FROM parted JOIN votes USING (key)", tables=_TABLES),
}
