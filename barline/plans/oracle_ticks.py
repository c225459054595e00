"""DuckDB SQL of the queries over ticks: that of the daily series, with a bar for each event."""

from __future__ import annotations

from barline.functions.ma import PERIODS
from barline.plans import oracle
from barline.sources.bars import BASE

#: A tick's place in its series: its time, and of equal times its number.
_BARS = f"""SELECT code, ts, close, 0 AS open, 0 AS high, 0 AS low, 0 AS vol FROM (SELECT code, ts,
    CAST({BASE} + sum(cents - (SELECT sum(cents) // count(*) FROM raw)) OVER (PARTITION BY code ORDER BY ts) AS BIGINT) AS close FROM raw)"""
_RAW = "SELECT event_type AS code, struct_pack(t := ts, e := event_id) AS ts, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents FROM events"
_TABLES = {"raw": _RAW} | oracle.TABLES | {"bars": _BARS}


ORACLE_SQL = {
    name: oracle.sql(body, tables=_TABLES)
    for name, body in {
        "tick_sums": "SELECT code, ts.e AS event_id, CAST(n AS BIGINT) AS n, " + ", ".join(f"s{k}" for k in PERIODS) + " FROM sums",
        "tick_stages": "SELECT * FROM stages",
        "tick_bullish_runs": 'SELECT code, start.t AS start, "end".t AS "end", bars, valid FROM bullish',
    }.items()
}
