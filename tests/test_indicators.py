"""Indicators against loops over each series, and in blocks of several sizes."""

import datetime
import math
import random
import statistics

import pytest

from barline.operators import indicators

DAY = datetime.date(2020, 1, 1)


def loop(bars):
    """All names, bar by bar: bars are (open, high, low, close, vol)."""
    o, h, lo, c, v = (list(x) for x in zip(*bars, strict=True))
    out, e12, e26, sig, k, d, atr, obv, vols = [], c[0], c[0], 0.0, 50.0, 50.0, None, 0, 0
    wilder = {w: [0.0, 0.0] for w in (7, 14)}
    ma = {p: [sum(c[i - p + 1 : i + 1]) / p if i >= p - 1 else None for i in range(len(c))] for p in (4, 8, 12, 16, 20, 47)}
    div = lambda a, b: a / b if a is not None and b not in (None, 0) else None
    sub = lambda a, b: a - b if a is not None and b is not None else None
    up = down = 0
    for i in range(len(c)):
        step = c[i] - c[i - 1] if i else 0
        for w, x in wilder.items():
            for j, part in enumerate((max(step, 0), max(-step, 0))):
                x[j] = 0.0 if not i else float(part) if i == 1 else x[j] * (w - 1) / w + part / w
        reach = h[i] - lo[i] if not i else max(h[i], c[i - 1]) - min(lo[i], c[i - 1])
        atr = float(reach) if not i else atr * 13 / 14 + reach / 14
        top, low = max(h[max(i - 8, 0) : i + 1]), min(lo[max(i - 8, 0) : i + 1])
        k = k * 2 / 3 + ((c[i] - low) / (top - low) * 100 if top > low else 50.0) / 3
        d = d * 2 / 3 + k / 3
        if i:
            e12, e26 = e12 * 11 / 13 + c[i] * 2 / 13, e26 * 25 / 27 + c[i] * 2 / 27
            sig = sig * 0.8 + (e12 - e26) * 0.2
        obv += v[i] * ((step > 0) - (step < 0))
        vols += v[i]
        up, down = (up + 1 if step > 0 else 0), (down + 1 if step < 0 else 0)
        f = {"close": c[i], "open": o[i], "high": h[i], "low": lo[i], "price_range": h[i] - lo[i], "price_change": c[i] - o[i], "price_change_ratio": div(c[i] - o[i], o[i])}
        for w in (3, 5, 10):
            own = c[i - w + 1 : i + 1] if i >= w - 1 else None
            f |= {f"close_mean_{w}": own and sum(own) / w, f"close_std_{w}": own and statistics.stdev(own), f"close_maxmin_{w}": own and max(own) - min(own), f"close_range_ratio_{w}": own and (max(own) - min(own)) / (sum(own) / w)}
        for p in ma:
            f |= {f"MA{p}": ma[p][i], f"MA{p}_slope": sub(ma[p][i], ma[p][i - 1]) if i else None}
        for p in (4, 8, 12):
            for q in (16, 20, 47):
                f |= {f"MA{p}_MA{q}_ratio": div(ma[p][i], ma[q][i]), f"MA{p}_MA{q}_diff": sub(ma[p][i], ma[q][i])}
        f |= {f"rsi_{w}": None if not i else 100 * x[0] / (x[0] + x[1]) if x[0] + x[1] else 50.0 for w, x in wilder.items()}
        dev = statistics.pstdev(c[i - 19 : i + 1]) if i >= 19 else None
        mid = ma[20][i]
        f |= {"kdj_k": k, "kdj_d": d, "kdj_j": 3 * k - 2 * d, "atr": atr, "atr_ratio": div(atr, c[i]), "bollinger_mid": mid, "bollinger_upper": mid and mid + 2 * dev, "bollinger_lower": mid and mid - 2 * dev, "bollinger_width": mid and 4 * dev / mid}
        f |= {"obv": obv, "obv_ratio": div(obv, vols), "wvad": sum((c[j] - o[j]) * v[j] / (h[j] - lo[j]) if h[j] > lo[j] else 0 for j in range(i - 23, i + 1)) if i >= 23 else None}
        for lag in (1, 2, 3):
            for name, x in (("close", c), ("vol", v)):
                f |= {f"{name}_lag_{lag}": x[i - lag] if i >= lag else None, f"{name}_lag_ratio_{lag}": div(x[i], x[i - lag]) if i >= lag else None}
        f |= {f"close_diff_{lag}": c[i] - c[i - lag] if i >= lag else None for lag in (1, 2)}
        f |= {"up_streak": up, "down_streak": down, "current_trend_duration": max(up, down), "macd": e12 - e26, "macd_signal": sig, "macd_hist": e12 - e26 - sig}
        out.append(f)
    return out


def series(seed, codes=3, n=260):
    rng, found = random.Random(seed), {}
    for code in range(codes):
        close, rows = 10_000, []
        for _ in range(n if code else 5):
            start = close
            close = max(100, close + rng.choice((-150, -50, 0, 50, 160)))
            rows.append((start, max(start, close) + rng.choice((0, 30)), min(start, close) - rng.choice((0, 20)), close, rng.choice((0, 10, 500))))
        found[str(code)] = rows
    found["flat"] = [(50, 50, 50, 50, 0)] * 60
    return found


@pytest.mark.parametrize("block", [40, 512])
def test_all_names(spark, block):
    found = series(block)
    rows = [(code, DAY + datetime.timedelta(days=3 * i), *b) for code, bars in found.items() for i, b in enumerate(bars)]
    df = spark.createDataFrame(rows, "code string, ts date, open long, high long, low long, close long, vol long")
    got = {(r.code, r.n): r for r in indicators.indicators(df, block).collect()}
    assert len(got) == len(rows) and len(indicators.NAMES) == len(set(indicators.NAMES)) == 83
    for code, bars in found.items():
        for n, f in enumerate(loop(bars)):
            for name in indicators.NAMES:
                a, b = got[code, n][name], f[name]
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)), (code, n, name, a, b)


def test_empty(spark):
    none = spark.createDataFrame([], "code string, ts date, open long, high long, low long, close long, vol long")
    assert indicators.indicators(none).collect() == []


def test_blocks_that_pass_a_double(spark):
    none = spark.createDataFrame([], "code string, ts date, open long, high long, low long, close long, vol long")
    with pytest.raises(ValueError, match="double"):
        indicators.indicators(none, 4096)
