"""DuckDB SQL of the queries that search, compare and judge; it builds on the table expressions of `oracle`."""

from __future__ import annotations

from barline.functions.ma import PERIODS
from barline.operators.patterns import CROSS_PAIRS, CROSS_WEIGHTS, GROUP_WEIGHTS, WEIGHTS, normalised
from barline.plans.oracle import _ORDERED, _W, LAST_BAR, each, sql
from barline.plans.queries import CODE, LO
from barline.sources.bars import BASE

_HIT = "coalesce(lag(s{p} * {q} <= s{q} * {p}) OVER (" + _W + ") AND s{p} * {q} > s{q} * {p}, false)"
_FILTERS = f"coalesce(vol > lag(vol) OVER ({_W}), true) AND (n <= 10 OR coalesce(close > lag(close, 9) OVER ({_W}), false))"
_ARRANGED = f"(SELECT * FROM (SELECT *, {_HIT.format(p=4, q=8)} AND {_FILTERS} AND {_ORDERED} AS hit FROM sums ) WHERE hit)"
_PLAIN = f"(SELECT * FROM (SELECT *, {_HIT.format(p=4, q=20)} AS hit FROM sums ) WHERE hit)"


def _runs(hits: str) -> str:
    return f"""(SELECT code, min(ts) AS start, max(ts) AS "end", max(n) AS last
        FROM (SELECT *, sum(CASE WHEN ts - before > 1 THEN 1 ELSE 0 END) OVER ({_W}) AS run FROM (SELECT *, lag(ts) OVER ({_W}) AS before FROM {hits}))
        GROUP BY code, run)"""


def _future(windows: str, days: int) -> str:
    """Returns of the bars after `hi`, as in the table expression `returns`."""
    return f"""(SELECT code, lo, hi, CAST(len(p) AS INTEGER) AS n_future,
        round(CASE WHEN len(r) > 0 THEN list_sum(r) / len(r) ELSE 0.0 END, 6) AS mean_return,
        round(CASE WHEN len(p) > 0 THEN (list_max(p) - list_min(p[list_position(p, list_max(p)):]))::DOUBLE / list_max(p) * 100 ELSE 0.0 END, 6) AS max_drawdown,
        round(CASE WHEN len(r) > 0 THEN list_max(r) ELSE 0.0 END, 6) AS max_rise, round(CASE WHEN len(r) > 0 THEN list_min(r) ELSE 0.0 END, 6) AS max_fall,
        round(CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda x: x > 0)) * 100.0 / len(r) ELSE 0.0 END, 6) AS win_rate
        FROM (SELECT code, lo, hi, p, list_transform(p[2:], lambda x: (x - p[1])::DOUBLE / p[1] * 100) AS r
            FROM (SELECT g.code, g.lo, g.hi, coalesce(list(close ORDER BY n) FILTER (WHERE n IS NOT NULL), []) AS p
                FROM {windows} g LEFT JOIN sums m ON g.code = m.code AND m.n > g.hi AND m.n <= g.hi + {days} GROUP BY g.code, g.lo, g.hi)))"""


_CELLS = ", ".join(f"max(CASE WHEN part = '{p}' AND point = {i} THEN {s} END) AS {p}_{s}_{i}" for p in ("around", "after") for s in ("s4", "s47") for i in range(5))
_INTERVALS = f"""SELECT g.code, g.start, g."end", g.start - 3 AS ext_start, g."end" + 3 AS ext_end, g.k, f.mean_return AS five_day_return, b.bars_around, b.bars_after, v.* EXCLUDE (code, last),
    round((SELECT avg(mean_return) FROM future5 ), 6) AS overall_return
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY start) AS INTEGER) AS k FROM runs48 ) g
    JOIN future5 f ON f.code = g.code AND f.hi = g.last
    JOIN (SELECT r.code, r.last, count(*) FILTER (WHERE m.ts BETWEEN r.start - 3 AND r."end" + 3) AS bars_around, count(*) FILTER (WHERE m.ts > r."end" AND m.ts <= r."end" + 30) AS bars_after
        FROM runs48 r LEFT JOIN sums m ON m.code = r.code GROUP BY r.code, r.last) b ON b.code = g.code AND b.last = g.last
    JOIN (SELECT code, last, {_CELLS}
        FROM (SELECT p.code, p.last, p.part, p.point, coalesce(i.s4, 0) AS s4, coalesce(i.s47, 0) AS s47
            FROM (SELECT code, last, part, CAST(point AS INTEGER) AS point, CASE WHEN point = 4 THEN e WHEN d < 4 THEN s + CAST(point AS INTEGER) ELSE s + CAST(floor(d * 0.25 * point) AS INTEGER) END AS ts
                FROM (SELECT *, e - s AS d, unnest([0, 1, 2, 3, 4]) AS point FROM (
                    SELECT code, last, 'around' AS part, start - 3 AS s, "end" + 3 AS e FROM runs48 UNION ALL SELECT code, last, 'after', "end" + 1, "end" + 30 FROM runs48 ))) p
            ASOF LEFT JOIN index_sums i ON p.ts >= i.ts)
        GROUP BY code, last) v ON v.code = g.code AND v.last = g.last
    WHERE g.k <= 5"""

_ALIKE = "(SELECT code, start AS lo, start + 9 AS hi, similarity FROM scored WHERE similarity >= 0.7)"
_DATED = f"""SELECT w.code, CAST(w.lo AS BIGINT) AS lo, a.ts AS start, b.ts AS "end", round(w.similarity + 1e-9, 2) AS similarity, f.* EXCLUDE (code, lo, hi)
    FROM {_ALIKE} w JOIN sums a ON a.code = w.code AND a.n = w.lo JOIN sums b ON b.code = w.code AND b.n = w.hi"""


def _verdicts(windows: str) -> str:
    """The three rules' stages of windows (code, stage, lo, hi, start, end)."""
    ends = "one AND NOT early AND late"
    pick = lambda three, two, one: f"CASE WHEN bars >= 2 AND {three} THEN 'stage3' WHEN bars >= 2 AND {two} THEN 'stage2' WHEN bars >= 2 AND {one} THEN 'stage1' ELSE 'unknown' END"
    return f"""(SELECT code, stage, lo, hi, start, "end", bars, {pick("dropped AND whole", "two AND bars > 3", "one AND bars > 3")} AS live, {pick(ends, "two", "one")} AS second, {pick(f"{ends} AND dropped", "two", "one")} AS backup
        FROM (SELECT code, stage, lo, hi, start, "end", CAST(count(place) AS INTEGER) AS bars, coalesce(bool_or(ts < start AND r > 47 AND only4), false) AS dropped,
            coalesce(bool_and(NOT joint) FILTER (WHERE place >= 1), true) AS whole, coalesce(bool_and(s2) FILTER (WHERE place >= 1), true) AS two, coalesce(bool_and(rc >= 4) FILTER (WHERE place >= 1), true) AS one,
            coalesce(bool_or(joint) FILTER (WHERE place >= 1 AND place < final), false) AS early, coalesce(bool_or(joint) FILTER (WHERE place >= 1 AND place = final), false) AS late
            FROM (SELECT *, max(place) OVER (PARTITION BY code, stage, lo, hi) AS final
                FROM (SELECT *, CASE WHEN r >= 47 AND ts BETWEEN start AND "end" THEN row_number() OVER (PARTITION BY code, stage, lo, hi, r >= 47 AND ts BETWEEN start AND "end" ORDER BY ts) - 1 END AS place
                    FROM (SELECT w.code, w.stage, w.lo, w.hi, w.start, w."end", b.ts, f.s2, f.rc, f.only4, f.joint, row_number() OVER (PARTITION BY w.code, w.stage, w.lo, w.hi ORDER BY b.ts) AS r
                        FROM {windows} w LEFT JOIN bars b ON b.code = w.code AND b.ts BETWEEN w.start - 100 AND w."end" + 100 LEFT JOIN flags f ON f.code = b.code AND f.ts = b.ts)))
            GROUP BY code, stage, lo, hi, start, "end"))"""


_SEGMENTS = '(SELECT code, stage, lo, hi, start, "end" FROM features )'
_FIRST = f"""(SELECT code, stage, lo, hi, start, "end" FROM features WHERE code = '{CODE}' AND stage = 'stage1' ORDER BY lo, hi LIMIT 1)"""
_LATEST = """(SELECT code, '' AS stage, 0 AS lo, 0 AS hi, min(ts) AS start, max(ts) AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS back FROM bars ) WHERE back <= 10 GROUP BY code HAVING count(*) = 10)"""
_COSINE = "round((" + " + ".join(f"a.f{i} * b.f{i}" for i in range(18)) + ") / sqrt((" + " + ".join(f"a.f{i} * a.f{i}" for i in range(18)) + ") * (" + " + ".join(f"b.f{i} * b.f{i}" for i in range(18)) + ")), 6)"
_EXPORTED = """(SELECT m.code, m.ts, CAST(m.n AS BIGINT) AS n, CAST(CASE WHEN m.ts BETWEEN c.start AND c."end" THEN k ELSE 0 END AS INTEGER) AS label
    FROM (SELECT code, start, "end", CAST(stage[6] AS INTEGER) AS k FROM current ) c JOIN sums m ON m.code = c.code
    WHERE m.n >= coalesce((SELECT max(n) FROM sums x WHERE x.code = c.code AND x.ts <= c.start), 0) - 60)"""
_INSIDE = """(SELECT g.code, g.start, g."end", min(m.n) AS lo, max(m.n) AS hi FROM (SELECT DISTINCT code, start - 1 AS start, "end" + 1 AS "end" FROM features WHERE stage = 'stage2') g
    JOIN sums m ON m.code = g.code AND m.ts BETWEEN g.start AND g."end" GROUP BY g.code, g.start, g."end")"""


def _resampled(x: str, length: str) -> str:
    place = f"i * (len({x}) - 1) / greatest({length} - 1, 1)::DOUBLE"
    low = f"CAST(least(floor({place}), greatest(len({x}) - 2, 0)) AS BIGINT)"
    return f"CASE WHEN len({x}) = {length} OR len({x}) = 0 THEN {x} ELSE list_transform(range(0, {length}), lambda i: {x}[{low} + 1] + (coalesce({x}[{low} + 2], {x}[{low} + 1]) - {x}[{low} + 1]) * ({place} - {low})) END"


def _unified(pairs: str) -> str:
    """Lists a and b of the same keys at the longer one's length."""
    longer = "greatest(len(a), len(b))"
    return f"(SELECT * REPLACE ({_resampled('a', longer)} AS a, {_resampled('b', longer)} AS b) FROM {pairs})"


def _warps(name: str, pairs: str) -> str:
    """Warping distances of lists a and b by `key`: cells one by one, the last row of them at hand."""
    return f"""{name}_walk AS (SELECT key, a, b, 0 AS t, CAST([] AS DOUBLE[]) AS cells FROM {pairs} WHERE len(a) > 0 AND len(b) > 0
        UNION ALL SELECT key, a, b, t + 1, list_append(cells[-len(b):], least(
            CASE WHEN t = 0 THEN c END, CASE WHEN t % len(b) > 0 THEN cells[-1] + c END, CASE WHEN t >= len(b) THEN cells[-len(b)] + c END, CASE WHEN t % len(b) > 0 AND t >= len(b) THEN cells[-len(b) - 1] + 2 * c END))
        FROM (SELECT *, abs(a[CAST(floor(t / len(b)) AS BIGINT) + 1] - b[t % len(b) + 1]) AS c FROM {name}_walk WHERE t < len(a) * len(b))),
        {name} AS (SELECT key, cells[-1] AS d FROM {name}_walk WHERE t = len(a) * len(b))"""


def _lines(days: int, where: str = "") -> str:
    """Each code's lines over its last bars, as lists."""
    values = ", ".join(f"s{k} / {k}.0 - {BASE}" for k in PERIODS)
    return f"""(SELECT code, k, list(v ORDER BY i) AS v FROM (SELECT code, -back AS i, unnest([{", ".join(map(str, PERIODS))}]) AS k, unnest([{values}]) AS v FROM tailed WHERE back <= {days} AND total >= {days} {where}) GROUP BY code, k)"""


_NEAR = "greatest(0, least(1, 1 - abs({a} - {b}) / (abs({a}) + abs({b}) + 1e-10)))"
_METRICS = f"""SELECT key, round(coalesce(avg(CASE WHEN dx IS NOT NULL THEN CAST(sign(dx) = sign(dy) AS INTEGER) END), 0), 6) AS direction,
    round({_NEAR.format(a="regr_slope(x, i)", b="regr_slope(y, i)")}, 6) AS slope,
    round(1 - abs(stddev_pop(x) - stddev_pop(y)) / (stddev_pop(x) + stddev_pop(y) + 1e-10), 6) AS volatility,
    round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN (corr(x, y) + 1) / 2 ELSE 0.5 END, 6) AS pearson,
    round(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN (corr(rx, ry) + 1) / 2 ELSE 0.5 END, 6) AS spearman,
    round(1 - least(coalesce(any_value(d) / nullif(sqrt(count(*) * (greatest(max(x), max(y)) - least(min(x), min(y))) ** 2), 0), 0), 1), 6) AS dtw,
    round({_NEAR.format(a=f"(avg(x) + {BASE})", b=f"(avg(y) + {BASE})")}, 6) AS mean_level
    FROM (SELECT key, i, x, y, d, x - lag(x) OVER (PARTITION BY key ORDER BY i) AS dx, y - lag(y) OVER (PARTITION BY key ORDER BY i) AS dy,
        rank() OVER (PARTITION BY key ORDER BY x) + (count(*) OVER (PARTITION BY key, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY key ORDER BY y) + (count(*) OVER (PARTITION BY key, y) - 1) / 2.0 AS ry
        FROM (SELECT u.key, unnest(range(len(u.a))) AS i, unnest(u.a) AS x, unnest(u.b) AS y, w.d FROM unified u JOIN warped w USING (key)))
    GROUP BY key"""


def _compared(lines: str, where: str = "") -> str:
    """Table expressions: strands, unified, warped and metrics of every code's lines and the target's, by key = code|k."""
    pairs = f"(SELECT a.code || '|' || a.k AS key, a.v AS a, b.v AS b FROM strands a JOIN strands b ON a.k = b.k AND b.code = '{CODE}' {where})"
    return f"strands AS {lines}, unified AS {_unified(pairs)}, {_warps('warped', 'unified')}, metrics AS ({_METRICS})"


def _places(upper: str, lower: str) -> str:
    return f"list_transform(list_filter(range(1, len({upper})), lambda i: {upper}[i] <= {lower}[i] AND {upper}[i + 1] > {lower}[i + 1]), lambda x: CAST(x AS DOUBLE))"


def _crossed(weights: dict[str, float] = CROSS_WEIGHTS, golden: bool = True, resampled: bool = True) -> str:
    """Table expressions over `strands`: crossover of every code."""
    pairs = " OR ".join(f"(a.k = {p} AND b.k = {q})" for p, q in CROSS_PAIRS)
    alike = lambda kind, c: "1.0" if kind == "golden" and not golden else f"avg(CASE WHEN kind = '{kind}' THEN {c} END)"
    whole = " + ".join(f"{alike(*n.split('_'))} * {w!r}" for n, w in normalised(weights).items())
    found = f"(SELECT a.code, a.k || '/' || b.k AS pair, unnest(['golden', 'death']) AS kind, unnest([{_places('a.v', 'b.v')}, {_places('b.v', 'a.v')}]) AS places, len(a.v) AS size FROM strands a JOIN strands b ON a.code = b.code AND ({pairs}))"
    return f"""crossing AS {found},
        facing AS (SELECT a.code, a.kind, a.code || a.pair || a.kind AS key, a.places AS a, b.places AS b, len(a.places) AS n1, len(b.places) AS n2, b.size FROM crossing a JOIN crossing b ON a.pair = b.pair AND a.kind = b.kind AND b.code = '{CODE}'),
        placed AS {_unified("facing") if resampled else "(SELECT * FROM facing)"}, {_warps("moved", "placed")},
        crossover AS (SELECT code, round({whole}, 6) AS crossover FROM (
            SELECT code, kind, 1 - abs(n1 - n2) / (greatest(n1, n2, 1) + 1e-10) AS count,
                CASE WHEN n1 = 0 AND n2 = 0 THEN 1.0 WHEN n1 = 0 OR n2 = 0 THEN 0.0 WHEN len(a) < 2 AND {resampled} THEN 1 - least(abs(list_avg(a) - list_avg(b)) / size, 1.0) ELSE 1 - d / (size * greatest(n1, n2) + {1e-10 if resampled else 0}) END AS position
            FROM placed LEFT JOIN moved USING (key)) GROUP BY code)"""


def _grouped(lines: str, top: int, weights=WEIGHTS, groups=GROUP_WEIGHTS, crosses=CROSS_WEIGHTS, golden: bool = True, without: str = "", resampled: bool = True) -> str:
    own = " + ".join(f"{n} * {w!r}" for n, w in normalised(weights).items())
    g = normalised(groups)
    body = f"""SELECT code, round({g["lines"]!r} * mean + {g["crossover"]!r} * crossover, 6) AS similarity
        FROM (SELECT split_part(key, '|', 1) AS code, sum({own}) / {len(PERIODS)} AS mean FROM metrics GROUP BY 1) JOIN crossover USING (code) {without}
        ORDER BY similarity DESC, code LIMIT {top}"""
    return sql(body, _compared(lines), _crossed(crosses, golden, resampled))


_UNEVEN = f"(SELECT * FROM {_lines(13, f'''AND code <> '{CODE}' ''')} UNION ALL SELECT * FROM {_lines(20, f'''AND code = '{CODE}' ''')})"
_RUNS48, _FUTURE5 = f"runs48 AS {_runs(_ARRANGED)}", f"future5 AS {_future('(SELECT code, last AS lo, last AS hi FROM runs48 )', 5)}"
_PART = "CASE WHEN CAST('0x' || substr(md5(concat_ws('|', code, '42')), 1, 7) AS BIGINT) < CAST(floor(0.7 * 268435456) AS BIGINT) THEN 'train' ELSE 'test' END"

#: Boxes one by one, the best first; those that are kept are at hand as a list. Areas count the last pixel.
_BOXES = """WITH RECURSIVE boxes AS (SELECT o_orderpriority AS key, o_orderkey % 97 AS x1, o_custkey % 89 AS y1, o_orderkey % 97 + 10 + o_orderkey % 13 AS x2, o_custkey % 89 + 12 AS y2, max(o_totalprice) AS score FROM orders GROUP BY 1, 2, 3, 4, 5),
    ranked AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY score DESC, x1, y1, x2, y2) AS place, {'a': x1, 'b': y1, 'c': x2, 'd': y2, 's': score} AS box FROM boxes),
    walk AS (SELECT key, place, [box] AS kept FROM ranked WHERE place = 1
        UNION ALL SELECT key, place, CASE WHEN list_bool_or(list_transform(kept, lambda k: 10 * greatest(least(k.c, box.c) - greatest(k.a, box.a) + 1, 0) * greatest(least(k.d, box.d) - greatest(k.b, box.b) + 1, 0)
                > 4 * ((k.c - k.a + 1) * (k.d - k.b + 1) + (box.c - box.a + 1) * (box.d - box.b + 1) - greatest(least(k.c, box.c) - greatest(k.a, box.a) + 1, 0) * greatest(least(k.d, box.d) - greatest(k.b, box.b) + 1, 0))))
            THEN kept ELSE list_append(kept, box) END
        FROM (SELECT w.key, b.place, w.kept, b.box FROM walk w JOIN ranked b ON b.key = w.key AND b.place = w.place + 1))
    SELECT key, CAST(k.a AS DOUBLE) AS x1, CAST(k.b AS DOUBLE) AS y1, CAST(k.c AS DOUBLE) AS x2, CAST(k.d AS DOUBLE) AS y2, k.s AS score FROM (SELECT key, unnest(max_by(kept, place)) AS k FROM walk GROUP BY key)"""

ORACLE_SQL = {
    "golden_cross_arranged": sql(f"SELECT code, ts, close FROM {_ARRANGED}"),
    "golden_cross_intervals": sql(_INTERVALS, _RUNS48, _FUTURE5),
    "golden_cross_older": sql(
        f"""SELECT g.code, g.start, g."end", round(avg(CASE WHEN m.n > g.last THEN m.step END), 9) AS mean_step
        FROM {_runs(_PLAIN)} g JOIN (SELECT code, n, close / lag(close) OVER ({_W}) - 1 AS step FROM sums ) m ON m.code = g.code AND m.n BETWEEN g.last AND g.last + 4 GROUP BY g.code, g.start, g."end" """
    ),
    "golden_cross_default": sql(f"SELECT code, ts, close FROM (SELECT *, {_HIT.format(p=4, q=12)} AND {_FILTERS} AND {_ORDERED} AS hit FROM sums ) WHERE hit"),
    "golden_cross_older_intervals": sql(
        _INTERVALS.replace("f.mean_return AS", "round(coalesce(f.mean_return, 0.0), 9) AS").replace("FROM future5 ), 6)", "FROM future5 ), 9)"),
        f"runs48 AS {_runs(_PLAIN)}",
        f"""future5 AS (SELECT g.code, g.last AS hi, avg(CASE WHEN m.n > g.last THEN m.step END) AS mean_return
            FROM runs48 g JOIN (SELECT code, n, close / lag(close) OVER ({_W}) - 1 AS step FROM sums ) m ON m.code = g.code AND m.n BETWEEN g.last AND g.last + 4 GROUP BY g.code, g.last)""",
    ),
    "pattern_report": sql(f"SELECT * EXCLUDE (n_future), row_number() OVER (ORDER BY similarity DESC, code, lo) AS rank FROM ({_DATED} JOIN {_future(_ALIKE, 5)} f ON f.code = w.code AND f.lo = w.lo)"),
    "pattern_overall_return": sql(f"SELECT count(*) AS windows, round(coalesce(avg(mean_return) FILTER (WHERE n_future > 0), 0.0), 4) AS mean_return FROM {_future(_ALIKE, 5)}"),
    "pattern_report_older": sql(
        f"SELECT code, lo, similarity, n_future, mean_return, rank FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY similarity DESC, lo) AS rank FROM ({_DATED} JOIN {_future(_ALIKE, 30)} f ON f.code = w.code AND f.lo = w.lo)) WHERE rank <= 10"
    ),
    "line_similarity_warped": sql(f"SELECT split_part(key, '|', 1) AS code, dtw, spearman FROM metrics", _compared(_lines(20), "WHERE a.k = 4")),
    "crossover_similarity": sql("SELECT * FROM crossover", f"strands AS {_lines(20)}", _crossed()),
    "group_similarity": _grouped(_lines(20), 20),
    "group_similarity_older": _grouped(_lines(20), 10, without=f"WHERE code <> '{CODE}'", resampled=False),
    "group_similarity_uneven": _grouped(_UNEVEN, 25, {"direction": 1, "slope": 2, "volatility": 1, "pearson": 2, "mean_level": 1}, {"lines": 3, "crossover": 1}, {"death_count": 2, "golden_count": 1, "golden_position": 1}, False),
    "window_verdicts": sql(f"SELECT * FROM {_verdicts(_SEGMENTS)}"),
    "window_stage": sql(f"SELECT * EXCLUDE (stage, lo, hi) FROM {_verdicts(_LATEST)}"),
    "similar_stages": sql(
        f"""SELECT code, stage, lo, hi, round(similarity, 4) AS similarity FROM (SELECT a.code, a.stage, a.lo, a.hi, {_COSINE} AS similarity
        FROM features a JOIN {_verdicts(_FIRST)} v ON a.stage = v.second JOIN features b ON b.code = v.code AND b.stage = v.stage AND b.lo = v.lo AND b.hi = v.hi) WHERE similarity >= 0.8"""
    ),
    "same_stage_split": sql(
        f"""SELECT a.code, a.stage, a.lo, a.hi, a.duration_type, a.duration_type = CASE WHEN v.bars > (CASE v.second WHEN 'stage2' THEN 4 ELSE 10 END) THEN 'long' ELSE 'short' END AS same_type
        FROM features a JOIN {_verdicts(_FIRST)} v ON a.stage = v.second"""
    ),
    "screen_export": sql(f"SELECT * FROM {_EXPORTED}"),
    "screen_history": sql(
        f"""SELECT f.code, f.label, f.first, CAST(m.n AS BIGINT) AS n FROM (SELECT code, label, min(n) AS first FROM exported WHERE label <> 0 GROUP BY code, label) f
        JOIN exported m ON m.code = f.code AND m.n BETWEEN f.first - 60 AND f.first - 1""",
        f"exported AS {_EXPORTED}",
    ),
    "classifier_rows": sql(
        """SELECT e.code, e.label, m.n, CASE WHEN m.n >= e.lo THEN 'target' ELSE 'history' END AS part, d.duration, CASE WHEN d.duration > (CASE WHEN e.label = 2 THEN 4 ELSE 10 END) THEN 'long' ELSE 'short' END AS duration_type
        FROM (SELECT code, label, min(n) AS lo, max(n) AS hi FROM exported WHERE label <> 0 GROUP BY code, label) e
        JOIN exported m ON m.code = e.code AND m.n BETWEEN e.lo - 60 AND e.hi
        JOIN (SELECT a.code, a.label, count(*) FILTER (WHERE b.n >= a.lo) AS duration, count(*) FILTER (WHERE b.n < a.lo) AS before
            FROM (SELECT code, label, min(n) AS lo, max(n) AS hi FROM exported WHERE label <> 0 GROUP BY code, label) a JOIN exported b ON b.code = a.code AND b.n BETWEEN a.lo - 60 AND a.hi GROUP BY a.code, a.label) d
        ON d.code = e.code AND d.label = e.label WHERE d.before > 0""",
        f"exported AS {_EXPORTED}",
    ),
    "bars_on_cross_days": sql(f"SELECT code, ts, close FROM sums WHERE ts IN (SELECT ts FROM (SELECT code, ts, {_HIT.format(p=4, q=12)} AS hit FROM sums ) WHERE hit AND code = '{CODE}')"),
    "labelled_days": sql(
        """SELECT substr(m.code, 1, 6) AS code, m.ts, m.close, 2 AS label FROM sums m
        JOIN (SELECT DISTINCT substr(g.code, 1, 6) AS key, x.ts FROM stages g JOIN sums x ON x.code = g.code AND x.n BETWEEN g.lo AND g.hi WHERE g.stage = 'stage2') d ON d.key = substr(m.code, 1, 6) AND d.ts = m.ts"""
    ),
    "range_history": sql(
        f"""SELECT code, start, "end", ts, n, part, count(*) FILTER (WHERE part = 'history') OVER w AS n_history, count(*) FILTER (WHERE part = 'target') OVER w AS n_target
        FROM (SELECT g.code, g.start, g."end", m.ts, CAST(m.n AS BIGINT) AS n, CASE WHEN m.n >= g.lo THEN 'target' ELSE 'history' END AS part FROM {_INSIDE} g JOIN sums m ON m.code = g.code AND m.n BETWEEN g.lo - 50 AND g.hi)
        WINDOW w AS (PARTITION BY code, start, "end")"""
    ),
    "five_bar_windows": sql(f"""SELECT a.code, a.n AS lo, a.ts AS start, b.ts AS "end" FROM sums a JOIN sums b ON a.code = b.code AND b.n = a.n + 4"""),
    "warm_up_sums": sql(
        f"""SELECT code, ts, CAST(rn - 47 AS INTEGER) AS n, {each("CASE WHEN rn >= {k} THEN s{k} END AS s{k}")}
        FROM (SELECT *, row_number() OVER ({_W}) AS rn, """ + each(f"CAST(sum(close) OVER ({_W} ROWS BETWEEN {{k}} - 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s{{k}}") + " FROM bars )"
    ),
    "calendar_tail": sql("SELECT code, ts, close FROM bars WHERE ts >= (SELECT max(ts) - 90 FROM bars )"),
    "head_bars": sql(f"SELECT code, ts, close FROM (SELECT *, row_number() OVER ({_W}) AS rn FROM bars ) WHERE rn <= 40"),
    "label_summary": sql(
        """SELECT stage, count(*) FILTER (WHERE duration_type = 'long') AS long, count(*) FILTER (WHERE duration_type = 'short') AS short, CAST(sum("end" - start + 1) AS BIGINT) AS days, min(start) AS first FROM features GROUP BY stage"""
    ),
    "box_suppression": _BOXES,
    "tree_features": f"SELECT code, round((ma4 - ma47) / greatest(ma4_std, abs(ma20_slope) + 1.0), 4) AS value, {_PART} AS part FROM ({LAST_BAR})",
}
