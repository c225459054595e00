"""DuckDB SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

from barline.functions.ma import PERIODS
from barline.plans.queries import CODE, LO
from barline.sources.bars import BASE

_W = "PARTITION BY code ORDER BY ts"


def each(text: str, join: str = ", ", periods: tuple[int, ...] = PERIODS) -> str:
    return join.join(text.replace("{k}", str(k)) for k in periods)


_PAIRS = list(zip(PERIODS, PERIODS[1:], strict=False))
_ORDERED = " AND ".join(f"s{p} * {q} > s{q} * {p}" for p, q in _PAIRS)
_REVERSED = " AND ".join(f"s{q} * {p} > s{p} * {q}" for p, q in _PAIRS)
TABLES = {
    "trades": "SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS ts, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS qty, (l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT)) AS place FROM lineitem JOIN part ON l_partkey = p_partkey",
    "days": "SELECT code, ts, arg_min(cents, place) AS open, arg_max(cents, place) AS close, max(cents) AS high, min(cents) AS low, CAST(sum(cents) // count(*) AS BIGINT) AS mean, CAST(sum(qty) AS BIGINT) AS vol FROM trades GROUP BY code, ts",
    "bars": f"SELECT code, ts, c + open - mean AS open, c + high - mean AS high, c + low - mean AS low, c AS close, vol FROM (SELECT *, CAST({BASE} + sum(mean - (SELECT CAST(sum(cents) // count(*) AS BIGINT) FROM trades)) OVER ({_W}) AS BIGINT) AS c FROM days)",
    "sums": f"SELECT code, ts, open, high, low, close, vol, CAST(rn - 47 AS INTEGER) AS n, {each('s{k}')} FROM (SELECT *, row_number() OVER ({_W}) AS rn, " + ", ".join(f"CAST(sum(close) OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS s{k}" for k in PERIODS) + " FROM bars) WHERE rn >= 47",
    "rises": f"SELECT *, {_ORDERED} AS ordered, " + ", ".join(f"coalesce(s{k} > lag(s{k}) OVER ({_W}), false) AS r{k}" for k in PERIODS) + f", coalesce(lag(s4 * 20 > s20 * 4) OVER ({_W}) AND s20 * 4 > s4 * 20, false) AS p4, coalesce(lag(s4 * 20 > s20 * 4) OVER ({_W}) AND NOT (s4 * 20 > s20 * 4), false) AS p5 FROM sums",
    "counted": f"SELECT *, CAST({each('CAST(r{k} AS INTEGER)', ' + ')} AS INTEGER) AS rc FROM rises",
    "flags": "SELECT *, ordered AND rc = 6 AND n >= 1 AS s2, n >= 1 AND NOT r4 AND rc = 5 AS only4, n >= 1 AND NOT r4 AND rc < 5 AS joint FROM counted",
    "marked": f"SELECT *, max(CASE WHEN rc < 4 AND n >= 1 THEN n END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS weak, min(CASE WHEN joint THEN n END) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next3, min(CASE WHEN p5 THEN n END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next5, min(CASE WHEN p4 THEN n END) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next4, coalesce(lead(only4) OVER ({_W}), false) AS qualified, max(n) OVER (PARTITION BY code) AS last FROM flags",
    "runs": f"SELECT code, min(n) AS a, max(n) AS b, arg_min(weak, n) AS weak0, min(CASE WHEN n = lo THEN weak END) AS weak, max(CASE WHEN n = hi THEN next3 END) AS next3, min(CASE WHEN n = lo THEN next5 END) AS next5, bool_or(n = hi AND qualified) AS qualified, max(CASE WHEN n = hi THEN next4 END) AS next4, min(ts) AS start_ts, max(ts) AS end_ts, max(last) AS last FROM (SELECT *, min(n) OVER (PARTITION BY code, island) AS lo, max(n) OVER (PARTITION BY code, island) AS hi FROM (SELECT *, n - row_number() OVER ({_W}) AS island FROM marked WHERE s2)) GROUP BY code, island",
    "stages": "SELECT code, stage, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi, hi < last AS closed FROM (SELECT code, last, 'stage1' AS stage, coalesce(weak + 1, 1) AS lo, a - 1 AS hi FROM runs WHERE a - coalesce(weak + 1, 1) > 3 UNION ALL SELECT code, last, 'stage2', a, b FROM runs WHERE b - a + 1 > 3 UNION ALL SELECT code, last, 'stage3', b + 1, next3 FROM runs WHERE b - a + 1 > 3 AND qualified AND next3 IS NOT NULL UNION ALL SELECT code, last, 'all', coalesce(weak + 1, 1), coalesce(next5, CASE WHEN b = last THEN last END) FROM runs WHERE a - coalesce(weak + 1, 1) > 3 AND (next5 IS NOT NULL OR b = last))",
    "features": "SELECT g.code, stage, lo, hi, min(ts) AS start, max(ts) AS \"end\", CAST(count(*) AS INTEGER) AS duration, CASE WHEN count(*) > (CASE stage WHEN 'stage2' THEN 4 ELSE 10 END) THEN 'long' ELSE 'short' END AS duration_type, " + ", ".join(f"CASE WHEN count(*) > 1 THEN (arg_max(s{k}, n) / {k}.0 - arg_min(s{k}, n) / {k}.0) / count(*) ELSE 0.0 END AS f{i}" for i, k in enumerate(PERIODS)) + ", " + ", ".join(f"coalesce(stddev_samp(s{k} / {k}.0), 0.0) AS f{6 + i}" for i, k in enumerate(PERIODS)) + ", " + ", ".join(f"avg(s{p} / {p}.0 - s{q} / {q}.0) AS f{12 + i}" for i, (p, q) in enumerate(_PAIRS)) + ", CAST(count(*) AS DOUBLE) AS f17 FROM (SELECT DISTINCT code, stage, lo, hi FROM stages ) g JOIN sums m ON g.code = m.code AND m.n BETWEEN g.lo AND g.hi GROUP BY g.code, stage, lo, hi",
    "bullish": f"SELECT code, min(ts) AS start, max(ts) AS \"end\", CAST(count(*) AS INTEGER) AS bars, arg_max(CASE WHEN next4 IS NULL THEN -1 ELSE next4 END, n) = -1 AS valid FROM (SELECT *, n - row_number() OVER ({_W}) AS island FROM marked WHERE s2 OR (ordered AND n = 0)) GROUP BY code, island",
    "future": "SELECT g.code, g.lo, g.hi, list(close ORDER BY n) FILTER (WHERE n IS NOT NULL) AS p FROM stages g LEFT JOIN sums m ON g.code = m.code AND m.n > g.hi AND m.n <= g.hi + 5 WHERE stage = 'stage2' GROUP BY g.code, g.lo, g.hi",
    "prices": "SELECT code, lo, hi, coalesce(p, []) AS p, list_transform(coalesce(p, [])[2:], lambda x: (x - p[1])::DOUBLE / p[1] * 100) AS r FROM future",
    "returns": "SELECT code, lo, hi, CAST(len(p) AS INTEGER) AS n_future, round(CASE WHEN len(r) > 0 THEN list_sum(r) / len(r) ELSE 0.0 END, 6) AS mean_return, round(CASE WHEN len(p) > 0 THEN (list_max(p) - list_min(p[list_position(p, list_max(p)):]))::DOUBLE / list_max(p) * 100 ELSE 0.0 END, 6) AS max_drawdown, round(CASE WHEN len(r) > 0 THEN list_max(r) ELSE 0.0 END, 6) AS max_rise, round(CASE WHEN len(r) > 0 THEN list_min(r) ELSE 0.0 END, 6) AS max_fall, round(CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda x: x > 0)) * 100.0 / len(r) ELSE 0.0 END, 6) AS win_rate FROM prices",
    "tailed": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY code) AS total FROM sums)",
    "longs": "SELECT code, n, o, v FROM (SELECT code, n, unnest([0, 1, 2, 3, 4, 5]) AS o, unnest([" + ", ".join(f"s{k} / {k}.0 - {BASE}" for k in PERIODS) + "]) AS v FROM sums)",
    "base": f"SELECT n - {LO} AS shift, o, v AS y FROM longs WHERE code = '{CODE}' AND n BETWEEN {LO} AND {LO + 9}",
    "windows": "SELECT l.code, l.n - b.shift AS start, count(*) AS items, sum(v) / 60 AS mx, sum(y) / 60 AS my, sum(v * v) / 60 AS mxx, sum(y * y) / 60 AS myy, sum(v * y) / 60 AS mxy, arg_min(v, shift * 10 + l.o) AS x0, arg_max(v, shift * 10 + l.o) AS x1, arg_min(y, shift * 10 + l.o) AS y0, arg_max(y, shift * 10 + l.o) AS y1 FROM longs l JOIN base b ON l.o = b.o WHERE l.n - b.shift >= 0 AND (l.n - b.shift) % 2 = 0 GROUP BY l.code, l.n - b.shift HAVING count(*) = 60",
    "spread": "SELECT *, sqrt(greatest(mxx - mx * mx, 0)) AS dx, sqrt(greatest(myy - my * my, 0)) AS dy FROM windows",
    "scored": "SELECT code, CAST(start AS INTEGER) AS start, round(0.4 * (1 + sign(t1 * t2) * CASE WHEN t1 = 0 AND t2 = 0 THEN 1.0 WHEN greatest(abs(t1), abs(t2)) = 0 THEN 0.0 ELSE least(abs(t1), abs(t2)) / greatest(abs(t1), abs(t2)) END) / 2 + 0.3 * exp(-CASE WHEN dx <= 1e-6 AND dy <= 1e-6 THEN 0.0 WHEN dx <= 1e-6 OR dy <= 1e-6 THEN 1.0 ELSE 2 * (1 - r) END) + 0.3 * r, 6) AS similarity FROM (SELECT *, CASE WHEN dx > 1e-6 AND dy > 1e-6 THEN (mxy - mx * my) / (dx * dy) ELSE 0.0 END AS r, CASE WHEN dx > 1e-6 THEN (x1 - x0) / dx ELSE 0.0 END AS t1, CASE WHEN dy > 1e-6 THEN (y1 - y0) / dy ELSE 0.0 END AS t2 FROM spread)",
    "last20": f"SELECT code, 20 - back AS i, s4 / 4.0 - {BASE} AS v FROM tailed WHERE back <= 20 AND total >= 20",
    "paired": f"SELECT a.code, a.i, a.v AS x, b.v AS y, a.v - lag(a.v) OVER (PARTITION BY a.code ORDER BY a.i) AS da, b.v - lag(b.v) OVER (PARTITION BY a.code ORDER BY a.i) AS db FROM last20 a JOIN last20 b ON a.i = b.i AND b.code = '{CODE}'",
    "lines": "SELECT code, round(avg(CASE WHEN da IS NOT NULL THEN CAST(sign(da) = sign(db) AS INTEGER) END), 6) AS direction, round(greatest(0, least(1, 1 - abs(regr_slope(x, i) - regr_slope(y, i)) / (abs(regr_slope(x, i)) + abs(regr_slope(y, i)) + 1e-10))), 6) AS slope, round(1 - abs(stddev_pop(x) - stddev_pop(y)) / (stddev_pop(x) + stddev_pop(y) + 1e-10), 6) AS volatility, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN (corr(x, y) + 1) / 2 ELSE 0.5 END, 6) AS pearson, round(greatest(0, least(1, 1 - abs(avg(x) - avg(y)) / (abs(avg(x) + BASE) + abs(avg(y) + BASE) + 1e-10))), 6) AS mean_level FROM paired GROUP BY code".replace("BASE", str(BASE)),
    "index_sums": "SELECT ts, s4, s47 FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS rn, CAST(sum(close) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS s4, CAST(sum(close) OVER (ORDER BY ts ROWS BETWEEN 46 PRECEDING AND CURRENT ROW) AS BIGINT) AS s47 FROM (SELECT ts, CAST(sum(close) // count(*) AS BIGINT) AS close FROM bars GROUP BY ts)) WHERE rn >= 47",
    "points": "SELECT code, lo, CAST(point AS INTEGER) AS point, CASE WHEN point = 4 THEN \"end\" WHEN d < 4 THEN start + CAST(point AS INTEGER) ELSE start + CAST(floor(d * 0.25 * point) AS INTEGER) END AS ts FROM (SELECT code, lo, start, \"end\", \"end\" - start AS d, unnest([0, 1, 2, 3, 4]) AS point FROM features WHERE stage = 'stage2')",
    "recent": "SELECT *, lag(fell) OVER (PARTITION BY code ORDER BY i) AS fell0, " + ", ".join(f"sum(CAST(coalesce(u{k}, false) AS INTEGER)) OVER (PARTITION BY code ORDER BY i) AS c{k}" for k in PERIODS) + ", sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY code ORDER BY i) AS bad, sum(CAST(coalesce(up, false) AS INTEGER)) OVER (PARTITION BY code ORDER BY i) AS ups FROM (SELECT code, ts, " + each("s{k}") + ", CAST(30 - back AS INTEGER) AS i, " + _ORDERED + " AS ok, " + ", ".join(f"s{k} > lag(s{k}) OVER w AS u{k}" for k in PERIODS) + ", " + " OR ".join(f"(lag(s{q} * {p} > s{p} * {q}) OVER w AND s{p} * {q} > s{q} * {p})" for j, p in enumerate(PERIODS) for q in PERIODS[j + 1 :]) + " AS up, list_stddev_samp([" + each("s{k} / {k}.0") + "]) AS wide, coalesce(lag(s4 * 20 > s20 * 4) OVER w AND s20 * 4 > s4 * 20, false) AS fell, coalesce(s4 < lag(s4) OVER w, false) AS lower FROM tailed WHERE back <= 30 AND total >= 30 WINDOW w AS (PARTITION BY code ORDER BY ts))",
    "found2": "SELECT a.code, a.i AS lo, b.i AS hi, a.ts AS start, b.ts AS \"end\", b.fell OR coalesce(b.fell0, false) AS fell, b.lower FROM recent a JOIN recent b ON a.code = b.code AND b.i - a.i >= 2 WHERE b.bad - a.bad + CAST(NOT a.ok AS INTEGER) = 0 AND " + each("b.c{k} - a.c{k} >= 0.6 * (b.i - a.i) AND b.s{k} > a.s{k}", " AND "),
    "found1": "SELECT a.code, a.i AS lo, b.i AS hi, a.ts AS start, b.ts AS \"end\", b.fell OR coalesce(b.fell0, false) AS fell, b.lower FROM recent a JOIN recent b ON a.code = b.code AND b.i - a.i >= 2 WHERE " + each("CAST(b.c{k} - a.c{k} >= 0.5 * (b.i - a.i) AND b.s{k} > a.s{k} AS INTEGER)", " + ") + " >= 3 AND b.ups - a.ups >= 2 AND b.wide > 1.2 * a.wide",
    "kept2": "SELECT * FROM found2 x WHERE NOT EXISTS (SELECT 1 FROM found2 y WHERE y.code = x.code AND y.lo <= x.lo AND y.hi >= x.hi AND (y.lo < x.lo OR y.hi > x.hi))",
    "kept1": "SELECT * FROM found1 x WHERE NOT EXISTS (SELECT 1 FROM found1 y WHERE y.code = x.code AND y.lo <= x.lo AND y.hi >= x.hi AND (y.lo < x.lo OR y.hi > x.hi))",
    "ends": "SELECT *, row_number() OVER (PARTITION BY code ORDER BY stage DESC, hi DESC, lo) AS r FROM (SELECT *, 'stage2' AS stage FROM kept2 WHERE hi = 29 AND NOT lower UNION ALL SELECT *, 'stage1' FROM kept1) WHERE NOT fell",
    "current": "SELECT code, lo, hi, start, \"end\", stage FROM ends WHERE r = 1",
    "phased": "SELECT *, CAST(floor((n - phase) / 21.0) AS INTEGER) AS k FROM (SELECT *, unnest([0, 10]) AS phase FROM sums) WHERE n >= phase",
    "gaps": f"SELECT *, sum(CAST(coalesce(ts - lag_ts > 1, false) AS INTEGER)) OVER ({_W}) AS run FROM (SELECT *, lag(ts) OVER ({_W}) AS lag_ts FROM flags WHERE ordered)",
    "falls": "SELECT r.code, r.start_ts AS start, r.end_ts AS stop, m.ts AS fall FROM runs r JOIN sums m ON m.code = r.code AND m.n = r.next4 WHERE r.b > r.a",
    "lagged": "SELECT code, ts, close, vol, n, " + each("s{k}, lag(s{k}) OVER w AS p{k}, lag(s{k}, 2) OVER w AS q{k}, lag(s{k}, 4) OVER w AS f{k}") + ", open, high, low, lag(close) OVER w AS pc, lag(vol) OVER w AS pv, " + f"stddev_samp(close) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS dc, stddev_samp(vol) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS dv, stddev_samp(s4) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS e4, stddev_samp(s20) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS e20, " + ", ".join(f"stddev_samp(s{k} / {k}.0) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS d{k}" for k in (4, 8, 20)) + f", row_number() OVER (PARTITION BY code ORDER BY ts DESC) AS back, row_number() OVER w AS total FROM sums WINDOW w AS ({_W})",
}


def sql(body: str, *more: str, tables: dict[str, str] | None = None) -> str:
    """The query with the table expressions that it needs, in order; `more` are its own, behind them. `tables` may stand in for TABLES."""
    tables = TABLES if tables is None else tables
    names, used = list(tables), set()

    def need(text: str) -> None:
        for name in names:
            if name not in used and _mentions(text, name):
                used.add(name)
                need(tables[name])

    need(" ".join([*more, body]))
    parts = [f"{n} AS ({tables[n]})" for n in names if n in used] + list(more)
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body


def _mentions(text: str, name: str) -> bool:
    return any(f"{word} {name}{end}" in text + " " for word in ("FROM", "JOIN") for end in (" ", ")", "\n"))


_LAST = {"close": "close", "vol": "vol", "bullish_alignment": f"CAST({_ORDERED} AS INTEGER)", "bearish_alignment": f"CAST({_REVERSED} AS INTEGER)"}
for _k in PERIODS:
    _LAST[f"ma{_k}"] = f"round(s{_k} / {_k}.0, 6)"
    _LAST[f"ma{_k}_slope"] = f"round(CASE WHEN f{_k} IS NULL THEN 0.0 ELSE s{_k} / f{_k} - 1 END, 6)"
for _k in (4, 8, 20):
    _LAST |= {f"ma{_k}_ma47_ratio": f"round((s{_k} / {_k}.0) / (s47 / 47.0), 6)", f"ma{_k}_ma47_diff": f"round(s{_k} / {_k}.0 - s47 / 47.0, 6)", f"ma{_k}_std": f"round(coalesce(d{_k}, 0.0), 4)"}
for _k in (4, 8, 20, 47):
    _LAST |= {f"price_ma{_k}_ratio": f"round(close * {_k} / s{_k}, 6)", f"price_above_ma{_k}": f"CAST(close * {_k} > s{_k} AS INTEGER)"}
for _k in (4, 20):
    _LAST |= {f"price_cross_ma{_k}": f"CAST(coalesce(pc * {_k} <= p{_k} AND close * {_k} > s{_k}, false) AS INTEGER)", f"ma{_k}_acceleration": f"round(coalesce((s{_k} - 2 * p{_k} + q{_k}) / {_k}.0, 0.0), 6)"}
_LAST |= {"price_up_volume_down": "CAST(coalesce(close > pc AND vol < pv, false) AS INTEGER)", "price_down_volume_down": "CAST(coalesce(close < pc AND vol < pv, false) AS INTEGER)", "price_change": "round(CASE WHEN pc IS NULL THEN 0.0 ELSE close / pc - 1 END, 6)", "volume_change": "round(CASE WHEN pv IS NULL THEN 0.0 ELSE vol / pv - 1 END, 6)"}

for _k in (4, 20):
    _LAST[f"ma{_k}_direction_change"] = f"CAST(coalesce(s{_k} > p{_k} AND p{_k} < q{_k}, false) AS INTEGER)"
_STRENGTH = {side: f"({' + '.join(f'CAST({a} AS INTEGER)' for a in text.split(' AND '))}) / 5" for side, text in (("bullish", _ORDERED), ("bearish", _REVERSED))}
_LAST |= {
    "ma_up_volume_up": "CAST(coalesce(s20 > p20 AND vol > pv, false) AS INTEGER)",
    "ma_down_volume_up": "CAST(coalesce(s20 < p20 AND vol > pv, false) AS INTEGER)",
    "ma4_ma20_spread": "round(abs(s4 * 5 - s20) / 20, 6)",
    "ma4_ma20_spread_change": "round(CASE WHEN p4 IS NULL THEN 0.0 WHEN p4 * 5 = p20 THEN 0.0 ELSE abs(s4 * 5 - s20) / abs(p4 * 5 - p20) - 1 END, 6)",
    "ma4_ma20_std_ratio": "round(CASE WHEN e20 > 0 THEN e4 * 5 / e20 ELSE 0.0 END, 4)",
    "bullish_strength": _STRENGTH["bullish"],
    "bearish_strength": _STRENGTH["bearish"],
    "trend_consistency": f"greatest({_STRENGTH['bullish']}, {_STRENGTH['bearish']})",
    "price_std_5": "round(coalesce(dc, 0.0), 4)",
    "volume_std_5": "round(coalesce(dv, 0.0), 4)",
    "open": "open",
    "high": "high",
    "low": "low",
}

#: Features that take more than 10 bars, and those that take more than 5.
_TEN = ("bullish_alignment", "bearish_alignment", *[k for k in _LAST if k.endswith(("_slope", "_ma47_ratio", "_ma47_diff", "_direction_change", "_acceleration")) and k.startswith("ma")])
_FIVE = ("price_std_5", "volume_std_5", "ma4_ma20_std_ratio", "ma4_ma20_spread", "ma4_ma20_spread_change", "bullish_strength", "bearish_strength", "trend_consistency", "price_up_volume_down", "price_down_volume_down", "ma_up_volume_up", "ma_down_volume_up")
_FIVE += ("ma4_std", "ma8_std", "ma20_std", *[k for k in _LAST if k.startswith(("price_ma", "price_above_", "price_cross_"))])
_LAST |= {k: f"CASE WHEN total > {least} THEN {_LAST[k]} ELSE 0 END" for least, names in ((10, _TEN), (5, _FIVE)) for k in names}

ORACLE_SQL = {
    name: sql(body)
    for name, body in {
        "bars_daily": "SELECT * FROM days",
        "bars_walk": "SELECT * FROM bars",
        "ma_sums": f"SELECT code, ts, n, {each('s{k}')} FROM sums",
        "ma_flags": "SELECT code, ts, ordered, rc, s2, only4, joint, p4, p5 FROM flags",
        "crosses": f"SELECT * FROM (SELECT code, ts, coalesce(lag(s4 * 12 <= s12 * 4) OVER ({_W}) AND s4 * 12 > s12 * 4, false) AS golden, coalesce(lag(s4 * 12 >= s12 * 4) OVER ({_W}) AND s12 * 4 > s4 * 12, false) AS death, p4 AS below, p5 AS not_above FROM flags ) WHERE golden OR death OR below OR not_above",
        "bullish_bars": "SELECT code, ts FROM flags WHERE ordered",
        "bullish_runs": "SELECT * FROM bullish",
        "last_bullish_run": "SELECT code, arg_max(start, \"end\") AS start, max(\"end\") AS \"end\" FROM bullish WHERE valid GROUP BY code",
        "stage_positions": "SELECT * FROM stages",
        "stage_features": "SELECT code, stage, lo, hi, start, \"end\", duration, duration_type, " + ", ".join(f"round(f{i} + 1e-6, 2) AS f{i}" for i in range(18)) + " FROM features",
        "stage_summary": "SELECT stage, duration_type, count(*) AS segments, CAST(sum(duration) AS BIGINT) AS bars FROM features GROUP BY stage, duration_type",
        "stage_context": "SELECT g.code, g.lo, m.ts, CASE WHEN m.n >= g.lo THEN 2 ELSE 0 END AS label FROM stages g JOIN sums m ON g.code = m.code AND m.n BETWEEN g.lo - 60 AND g.hi WHERE stage = 'stage2'",
        "end_phase": "SELECT f.code, f.start, m.ts, CASE WHEN m.ts BETWEEN f.start AND f.stop THEN 2 WHEN m.ts > f.stop AND m.ts <= f.fall THEN 4 ELSE 0 END AS label FROM falls f JOIN sums m ON m.code = f.code AND m.ts BETWEEN f.start - 10 AND f.fall + 10",
        "calendar_runs": "SELECT code, min(ts) AS start, max(ts) AS \"end\", CAST(count(*) AS INTEGER) AS bars FROM gaps GROUP BY code, run",
        "golden_cross_bars": f"SELECT code, ts, close FROM (SELECT *, coalesce(lag(s4 * 12 <= s12 * 4) OVER ({_W}) AND s4 * 12 > s12 * 4, false) AND coalesce(vol > lag(vol) OVER ({_W}), true) AND (n <= 10 OR coalesce(close > lag(close, 9) OVER ({_W}), false)) AS hit FROM sums ) WHERE hit",
        "forward_returns": "SELECT * FROM returns",
        "overall_forward_return": "SELECT count(*) AS segments, round(avg(CASE WHEN n_future > 0 THEN mean_return END), 4) AS mean_return FROM returns",
        "index_asof": "SELECT p.code, p.lo, p.point, p.ts, coalesce(i.s4, 0) AS s4, coalesce(i.s47, 0) AS s47 FROM points p ASOF LEFT JOIN index_sums i ON p.ts >= i.ts",
        "pattern_similarity": "SELECT * FROM scored",
        "pattern_top_per_code": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY code ORDER BY similarity DESC, start) AS INTEGER) AS rank FROM scored WHERE similarity >= 0.7) WHERE rank <= 10",
        "line_similarity": "SELECT * FROM lines",
        "same_stage_cosine": "SELECT a.code, a.lo, a.hi, round(round((" + " + ".join(f"a.f{i} * b.f{i}" for i in range(18)) + ") / sqrt((" + " + ".join(f"a.f{i} * a.f{i}" for i in range(18)) + ") * (" + " + ".join(f"b.f{i} * b.f{i}" for i in range(18)) + f")), 6), 4) AS similarity FROM features a, (SELECT * FROM features WHERE code = '{CODE}' AND stage = 'stage1' ORDER BY lo, hi LIMIT 1) b WHERE a.stage = 'stage1'",
        "screen_stage2": "SELECT code, lo, hi, start, \"end\" FROM kept2",
        "screen_stage1": "SELECT code, lo, hi, start, \"end\" FROM kept1",
        "screen_latest": "SELECT * FROM current",
        "tumbling_windows": f"SELECT code, phase, k, min(ts) AS start, max(ts) AS \"end\", bool_and({_ORDERED}) AND " + each("arg_max(s{k}, n) > arg_min(s{k}, n)", " AND ") + " AS bullish FROM phased GROUP BY code, phase, k HAVING count(*) = 21",
        "tail_bars": "SELECT code, ts, CAST(least(total, 20) - back AS INTEGER) AS i, close FROM tailed WHERE back <= 20",
        "last_bar_features": "SELECT code, " + ", ".join(f"{v} AS {k}" for k, v in _LAST.items()) + " FROM lagged WHERE back = 1",
        "event_hours": "SELECT event_type AS code, date_trunc('hour', ts) AS ts, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }.items()
}
LAST_BAR, LAST_CELLS = ORACLE_SQL["last_bar_features"], _LAST


def changed(at: str, new: dict[str, str], **changed: str) -> dict[str, str]:
    """TABLES with new expressions before the one named `at`, and others in place of theirs."""
    out = {}
    for name, text in TABLES.items():
        out |= (new if name == at else {}) | {name: changed.get(name, text)}
    return out


_STAGED = "SELECT * FROM sums WHERE (code, n) IN (SELECT m.code, m.n FROM stages g JOIN sums m ON m.code = g.code AND m.n BETWEEN g.lo AND g.hi WHERE g.stage = 'stage2')"
_TWENTY = TABLES["recent"].replace("30 - back", "20 - back").replace("back <= 30 AND total >= 30", "back <= 20 AND total >= 20")
ORACLE_SQL["stage_last_bars"] = sql("SELECT code, " + ", ".join(f"{v} AS {k}" for k, v in _LAST.items()) + " FROM lagged WHERE back = 1", tables=changed("lagged", {"staged": _STAGED}, lagged=TABLES["lagged"].replace(" FROM sums ", " FROM staged ")))
ORACLE_SQL["screen_two_spans"] = sql("SELECT * FROM current", tables=changed("found2", {"recent20": _TWENTY}, found2=TABLES["found2"].replace("recent ", "recent20 "), ends=TABLES["ends"].replace("hi = 29", "hi = 19")))
ORACLE_SQL["stage_features11"] = "SELECT code, stage, lo, hi, " + ", ".join(f"f{i if i < 6 else i + 6} AS f{i}" for i in range(11)) + f" FROM ({ORACLE_SQL['stage_features']})"
ORACLE_SQL["golden_cross_function"] = f"SELECT code, ts FROM ({ORACLE_SQL['crosses']}) WHERE golden"
ORACLE_SQL["same_stage_close"] = f"SELECT * FROM ({ORACLE_SQL['same_stage_cosine']}) WHERE similarity >= 0.8"
