"""DuckDB SQL of the indicator queries; recursive averages go bar by bar."""

from __future__ import annotations

from barline.functions.ma import PERIODS
from barline.operators.indicators import NAMES
from barline.plans import oracle

_W = "PARTITION BY code ORDER BY n"


def _span(k: int) -> str:
    return f"OVER ({_W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _whole(text: str, k: int) -> str:
    return f"CASE WHEN n >= {k - 1} THEN {text} END"


_STEPS = f"""SELECT *, close - lag(close) OVER ({_W}) AS step, greatest(high, coalesce(lag(close) OVER ({_W}), high)) - least(low, coalesce(lag(close) OVER ({_W}), low)) AS reach,
    coalesce((close - min(low) {_span(9)}) * 100.0 / nullif(max(high) {_span(9)} - min(low) {_span(9)}, 0), 50.0) AS rsv FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts) - 1 AS n FROM bars)"""
_WILDER = ", ".join(f"CASE WHEN s.n = 1 THEN greatest({sign}s.step, 0) ELSE (1 - 1 / {k}.0) * {name}{k} + greatest({sign}s.step, 0) / {k}.0 END" for k in (7, 14) for name, sign in (("gain", ""), ("loss", "-")))
_RECURSIVE = f"""SELECT code, n, 0.0::DOUBLE AS gain7, 0.0::DOUBLE AS loss7, 0.0::DOUBLE AS gain14, 0.0::DOUBLE AS loss14, reach::DOUBLE AS atr, 100 / 3.0::DOUBLE + rsv / 3 AS k, 100 / 3.0::DOUBLE + (100 / 3.0::DOUBLE + rsv / 3) / 3 AS d,
        close::DOUBLE AS e12, close::DOUBLE AS e26, 0.0::DOUBLE AS signal FROM steps WHERE n = 0
    UNION ALL SELECT s.code, s.n, {_WILDER}, atr * 13 / 14.0::DOUBLE + s.reach / 14.0::DOUBLE, k * 2 / 3.0::DOUBLE + s.rsv / 3, d * 2 / 3.0::DOUBLE + (k * 2 / 3.0::DOUBLE + s.rsv / 3) / 3,
        e12 * 11 / 13.0::DOUBLE + s.close * 2 / 13.0::DOUBLE, e26 * 25 / 27.0::DOUBLE + s.close * 2 / 27.0::DOUBLE,
        signal * 0.8::DOUBLE + 0.2::DOUBLE * (e12 * 11 / 13.0::DOUBLE + s.close * 2 / 13.0::DOUBLE - (e26 * 25 / 27.0::DOUBLE + s.close * 2 / 27.0::DOUBLE))
    FROM averages a JOIN steps s ON s.code = a.code AND s.n = a.n + 1"""

_CELLS = {c: c for c in ("close", "open", "high", "low")} | {"price_range": "high - low", "price_change": "close - open", "price_change_ratio": "(close - open) / nullif(open, 0)"}
for _k in (3, 5, 10):
    _width = f"(max(close) {_span(_k)} - min(close) {_span(_k)})"
    _CELLS |= {f"close_mean_{_k}": _whole(f"avg(close) {_span(_k)}", _k), f"close_std_{_k}": _whole(f"stddev_samp(close) {_span(_k)}", _k), f"close_maxmin_{_k}": _whole(_width, _k), f"close_range_ratio_{_k}": _whole(f"{_width} / (avg(close) {_span(_k)})", _k)}
_MA = {k: _whole(f"avg(close) {_span(k)}", k) for k in PERIODS}
for _p in PERIODS:
    _CELLS |= {f"MA{_p}": f"m{_p}", f"MA{_p}_slope": f"m{_p} - lag(m{_p}) OVER ({_W})"}
    if _p <= 12:
        _CELLS |= {f"MA{_p}_MA{q}_{name}": f"m{_p} {sign} m{q}" for q in (16, 20, 47) for name, sign in (("ratio", "/"), ("diff", "-"))}
_CELLS |= {f"rsi_{_k}": f"CASE WHEN n >= 1 THEN coalesce(100 * gain{_k} / nullif(gain{_k} + loss{_k}, 0), 50.0) END" for _k in (7, 14)}
_CELLS |= {"kdj_k": "k", "kdj_d": "d", "kdj_j": "3 * k - 2 * d", "atr": "atr", "atr_ratio": "atr / nullif(close, 0)"}
_DEV = _whole(f"stddev_pop(close) {_span(20)}", 20)
_CELLS |= {"bollinger_upper": f"m20 + 2 * ({_DEV})", "bollinger_mid": "m20", "bollinger_lower": f"m20 - 2 * ({_DEV})", "bollinger_width": f"4 * ({_DEV}) / nullif(m20, 0)"}
_SIGNED = f"(sum(coalesce(sign(step), 0) * vol) OVER ({_W} ROWS UNBOUNDED PRECEDING))"
_CELLS |= {"obv": f"CAST({_SIGNED} AS BIGINT)", "obv_ratio": f"{_SIGNED} / nullif(sum(vol) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0)"}
_CELLS["wvad"] = _whole(f"sum(coalesce((close - open) * vol / nullif((high - low)::DOUBLE, 0), 0.0)) {_span(24)}", 24)
for _k in (1, 2, 3):
    _CELLS |= {f"{_c}_lag_{_k}": f"lag({_c}, {_k}) OVER ({_W})" for _c in ("close", "vol")} | {f"{_c}_lag_ratio_{_k}": f"{_c} / nullif(lag({_c}, {_k}) OVER ({_W}), 0)" for _c in ("close", "vol")}
_CELLS |= {f"close_diff_{_k}": f"close - lag(close, {_k}) OVER ({_W})" for _k in (1, 2)}
_STREAK = {name: f"CAST(n - max(CASE WHEN NOT coalesce(step {sign} 0, false) THEN n END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS INTEGER)" for name, sign in (("up_streak", ">"), ("down_streak", "<"))}
_CELLS |= _STREAK | {"current_trend_duration": f"greatest({_STREAK['up_streak']}, {_STREAK['down_streak']})", "macd": "e12 - e26", "macd_signal": "signal", "macd_hist": "e12 - e26 - signal"}

TABLES = oracle.TABLES | {
    "steps": _STEPS,
    "averages": _RECURSIVE,
    "moving": "SELECT *, " + ", ".join(f"{v} AS m{p}" for p, v in _MA.items()) + " FROM (SELECT s.*, a.* EXCLUDE (code, n) FROM steps s JOIN averages a ON a.code = s.code AND a.n = s.n)",
    "cells": "SELECT code, ts, n, row_number() OVER (PARTITION BY code ORDER BY n DESC) AS back, " + ", ".join(f"{_CELLS[x]} AS {x}" for x in NAMES) + " FROM moving",
}

ORACLE_SQL = {
    name: oracle.sql(body, tables=TABLES)
    for name, body in {
        "indicator_bars": "SELECT code, ts, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("rsi_7", "rsi_14", "kdj_k", "kdj_d", "kdj_j", "atr_ratio")) + ", obv, up_streak, down_streak, current_trend_duration FROM cells",
        "model_features": "SELECT code, " + ", ".join(f"round(coalesce(CAST({x} AS DOUBLE), 0.0), 3) AS {x}" for x in NAMES) + " FROM cells WHERE back = 1",
    }.items()
}
