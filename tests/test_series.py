"""Hurst exponents, the Dickey-Fuller regression, log-periodic fits, ledgers and Kelly sizes against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import labels as L
from tidewright.operators import ledgers as T
from tidewright.operators import series as S


def near(a, b, eps=1e-8):
    return (a is None or a != a) and (b is None or b != b) or a is not None and b is not None and abs(a - b) <= eps * max(1, abs(a), abs(b))


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(5)
    walk = np.cumsum(rng.normal(size=260))
    return {"noise": rng.normal(size=300).tolist(), "walk": walk.tolist(), "short": rng.normal(size=12).tolist(), "flat": [1.0] * 90, "gaps": [None if i % 9 == 0 else float(x) for i, x in enumerate(rng.normal(size=150))]}


@pytest.fixture(scope="module")
def frame(spark, values):
    return spark.createDataFrame([(s, i + 1, v) for s, vs in values.items() for i, v in enumerate(vs)], "symbol string, seq long, x double").repartition(4)


def plain_hurst(x, kind):
    x = np.array([v for v in x if v is not None])
    n, points = len(x), []
    if n >= 20:
        top = n // 4
        for scale in sorted({10, top, *(int(10 * (top / 10) ** (i / 19)) for i in range(1, 19))}):
            values = []
            if kind == "rs":
                for k in range(n // scale):
                    part = x[k * scale : (k + 1) * scale]
                    walk = np.cumsum(part - part.mean())
                    if np.std(part, ddof=1) > 1e-10:
                        values.append((walk.max() - walk.min()) / np.std(part, ddof=1))
                value = np.mean(values) if values else 0
            else:
                profile = np.cumsum(x - x.mean())
                starts = [k * scale for k in range(n // scale)] + [n - (k + 1) * scale for k in range(n // scale)]
                for a in starts:
                    t, part = np.arange(scale), profile[a : a + scale]
                    values.append(np.mean((part - np.polyval(np.polyfit(t, part, 1), t)) ** 2))
                value = math.sqrt(np.mean(values))
            if value > 0:
                points.append((math.log(scale), math.log(value)))
    if len(points) < 3:
        return 0.5, 0.0
    a, b = np.array(points).T
    c = np.polyfit(a, b, 1)
    left, total = ((b - np.polyval(c, a)) ** 2).sum(), ((b - b.mean()) ** 2).sum()
    return float(np.clip(c[0], 0, 1)), max(0.0, 1 - left / (total + 1e-10))


@pytest.mark.parametrize("kind", ["rs", "dfa"])
def test_hurst(frame, values, kind):
    found = (S.hurst_scales if kind == "rs" else S.hurst_dfa)(frame, "x")
    got = {r["symbol"]: r for r in found.collect()}
    assert set(got) == set(values)
    for s, x in values.items():
        if s == "flat" and kind == "dfa":
            continue  # what rounding leaves of nothing has no slope
        h, r2 = plain_hurst(x, kind)
        assert near(got[s]["hurst"], h, 1e-6) and near(got[s]["r2"], r2, 1e-6), (s, got[s], h, r2)
    assert got["short"]["regime"] == "random_walk"


@pytest.mark.parametrize("kind", ["rs", "dfa"])
def test_hurst_rolling(frame, values, kind):
    got = {(r["symbol"], r["seq"]): r for r in S.hurst_rolling(frame.where("symbol IN ('noise', 'gaps', 'short')"), "x", method=kind).collect()}
    seen = 0
    for s in ("noise", "gaps", "short"):
        for i in range(0, len(values[s]), 7):
            window = [v for v in values[s][max(0, i - 99) : i + 1] if v is not None]
            r = got[(s, i + 1)]
            if len(window) < 50:
                assert r["hurst"] is None and r["regime"] is None
                continue
            h, r2 = plain_hurst(window, kind)
            assert near(r["hurst"], h, 1e-6) and near(r["r2"], r2, 1e-6)
            seen += 1
    assert seen > 30


@pytest.mark.parametrize("lags", [0, 1, 3])
def test_adf(frame, values, lags):
    got = {r["symbol"]: r for r in S.adf(frame, "x", lags).collect()}
    for s, x in values.items():
        y = np.array([v for v in x if v is not None])
        if s in ("short", "flat"):
            assert got[s]["adf_statistic"] is None and not got[s]["stationary"]
            continue
        d = np.diff(y)
        rows = range(lags, len(d))
        m = np.array([[1.0, y[t], *(d[t - i] for i in range(1, lags + 1))] for t in rows])
        z = d[lags:]
        b, *_ = np.linalg.lstsq(m, z, rcond=None)
        left = ((z - m @ b) ** 2).sum() / (len(z) - m.shape[1])
        t = b[1] / math.sqrt(left * np.linalg.inv(m.T @ m)[1, 1])
        assert near(got[s]["adf_statistic"], t, 1e-6) and got[s]["n_obs"] == len(z)
    assert got["noise"]["stationary"] and got["noise"]["p_value"] < 1e-6 and not got["walk"]["stationary"]


def test_p_values(spark):
    """The critical values of the fixed table lie at 1, 5 and 10 per cent."""
    p = [r[0] for r in spark.createDataFrame([(c,) for c in S.ADF_CRITICAL], "t double").select(S.adf_p_value(F.col("t"))).collect()]
    assert np.allclose(p, [0.01, 0.05, 0.10], atol=2e-3)


def test_bubble_fits(spark):
    rng = np.random.default_rng(3)
    t = np.arange(1, 91)
    d = 105.0 - t  # a critical time 15 bars after the last
    bubble = 5 - 0.05 * d**0.5 + 0.004 * d**0.5 * np.cos(8 * np.log(d))
    prices = {"bubble": np.exp(bubble + rng.normal(size=90) * 1e-4), "noise": np.exp(4 + 0.1 * rng.normal(size=90))}
    df = spark.createDataFrame([(s, int(i), float(v)) for s, vs in prices.items() for i, v in zip(t, vs)], "symbol string, seq long, close double")
    grid = {"windows": (40, 60), "every": 30, "ahead": (4, 14, 30), "powers": (0.3, 0.5), "frequencies": (6.0, 8.0)}
    fits = S.bubble_fits(df, **grid)
    got = {(r["symbol"], r["end"], r["window"]): r for r in S.fit_filters(fits).collect()}
    assert set(got) == {(s, e, w) for s in prices for e in (60, 90) for w in (40, 60) if e >= w}
    for (s, end, w), r in got.items():
        y = np.log(prices[s][end - w : end])
        best = None
        for a in grid["ahead"]:
            for m in grid["powers"]:
                for o in grid["frequencies"]:
                    dist = w + a - np.arange(w)
                    x = np.stack([np.ones(w), dist**m, dist**m * np.cos(o * np.log(dist)), dist**m * np.sin(o * np.log(dist))], 1)
                    b, *_ = np.linalg.lstsq(x, y, rcond=None)
                    ssr = ((y - x @ b) ** 2).sum()
                    if best is None or ssr < best[0] - 1e-12:
                        best = (ssr, a, m, o, b)
        assert (r["ahead"], r["m"], r["omega"]) == best[1:4]
        assert near(r["ssr"], best[0], 1e-6) and all(near(r[c], v, 1e-4) for c, v in zip(("a", "b", "c1", "c2"), best[4]))
        assert near(r["r2"], 1 - best[0] / ((y - y.mean()) ** 2).sum(), 1e-6)
        assert near(r["oscillations"], r["omega"] / (2 * math.pi) * math.log((w + r["ahead"]) / (r["ahead"] + 1)))
    top = got[("bubble", 90, 60)]
    assert (top["ahead"], top["m"], top["omega"]) == (14, 0.5, 8.0) and top["r2"] > 0.99
    assert top["failed"] == ["damping", "oscillations"] and not top["passed"] and near(top["quality"], (1 + 1 + (1.0 if top["damping"] >= 1.5 else 0.8 if top["damping"] >= 1 else 0.5 if top["damping"] >= 0.5 else 0) + (0.5 if top["oscillations"] >= 2 else 0) + 1 + 1) / 6)
    c = {(r["symbol"], r["end"]): r for r in S.bubble_confidence(S.fit_filters(fits)).collect()}
    assert c[("bubble", 90)]["windows"] == 2 and c[("bubble", 90)]["confidence"] == sum(got[("bubble", 90, w)]["passed"] for w in (40, 60)) / 2


# ---- ledgers ----


def some_bars(n=240, seed=3):
    rng, rows = random.Random(seed), []
    for s in "abc":
        p = 100.0
        for i in range(1, n + 1):
            o, p = p, p * math.exp(rng.gauss(0, 0.01))
            rows.append((s, i, o, max(o, p) * 1.002, min(o, p) * 0.998, p, rng.choice([None, 0, 0, 1, 1, -1]), rng.choice([None, 0.0, p * 0.999, p * 1.001, 1e18]), rng.uniform(0.5, 2.0)))
    return rows


BARS = "symbol string, seq long, open double, high double, low double, close double, sig int, stop double, u double"


def executed(rows, mode):
    """A bar-by-bar executor: exits first, then what the bar before asked for, then the bar's own signal."""
    out, pos, pending, before = [], None, None, 0
    for s, i, o, h, low, c, sig, stop, _ in rows:
        sig, stop, ended = sig or 0, stop or 0.0, False
        if pos:
            side, since = pos
            if mode == "stop" and stop > 0 and (low <= stop if side > 0 else h >= stop):
                out.append((s, since, i, side, stop, "sl"))
                pos, ended = None, True
            elif before == -side or (mode == "stop" and before == 0):
                out.append((s, since, i, side, stop if mode == "stop" and 0 < stop < 1e17 else o, "signal"))
                pos, ended = None, True
        if pending and not pos:
            pos, pending = (pending, i), None
        if ended and not pos and before and mode == "signal":
            pos = (before, i)
        pending = sig if not pos and sig else None
        before = sig
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_ledgers(spark, block):
    rows = some_bars()
    df = spark.createDataFrame(rows, BARS)
    for mode, candidates, taken in (("signal", T.signal_candidates(df, "sig", block=block), T.signal_trades), ("stop", T.stop_candidates(df, "sig", "stop", block=block), T.stop_trades)):
        got = sorted((r["symbol"], r["entry_seq"], r["exit_seq"], r["direction"], r["exit_price"], r["reason"]) for r in taken(candidates).collect())
        want = sorted(x for s in "abc" for x in executed([r for r in rows if r[0] == s], mode))
        assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want] and all(near(g[4], w[4]) for g, w in zip(got, want))
        per_row = candidates.groupBy("symbol", "entry_seq").count()
        assert per_row.where("count > 1").count() == 0


def test_fees_and_slip(spark):
    df = spark.createDataFrame([("a", i, 100.0, 101.0, 99.0, 100.0, 1 if i < 3 else -1, None, 1.0) for i in range(1, 7)], BARS)
    r = T.signal_trades(T.signal_candidates(df, "sig", F.lit(0.01))).collect()
    assert [(t["entry_seq"], t["exit_seq"]) for t in r] == [(2, 4)] and near(r[0]["entry_price"], 101.0) and near(r[0]["exit_price"], 99.0)
    assert r[0]["pnl"] < 99 / 101 - 1


def test_next_events_far_away(spark):
    df = spark.range(1, 2001).select(F.lit("a").alias("symbol"), F.col("id").alias("seq"), (F.col("id") == 1999).alias("e"))
    got = dict(T.next_events(df, {"n": F.col("e")}, 16).select("seq", "n").collect())
    assert got[1] == got[1998] == 1999 and got[1999] is None and got[2000] is None


def test_kelly_size(spark):
    rows, window = some_bars(200), 40
    got = {(r["symbol"], r["seq"]): r for r in T.kelly_size(spark.createDataFrame(rows, BARS), "sig", "u", window).collect()}
    seen = 0
    for s in "abc":
        own = [r for r in rows if r[0] == s]
        for i in range(len(own)):
            r = got[(s, i + 1)]
            if i < window:
                assert near(r["kelly_size"], 1.55) and r["kelly_trades"] is None
                continue
            trades, side, entry = [], 0, 0.0
            for j in range(i - window, i):
                sig, price = own[j][6] or 0, own[j][5]
                if side and sig != side:
                    trades.append(side * (price - entry) / entry)
                    side = 0
                if not side and sig:
                    side, entry = sig, price
            wins, losses = [t for t in trades if t > 0], [t for t in trades if t < 0]
            raw = 0.25
            if len(trades) >= 5 and wins and losses:
                rate, pay = len(wins) / len(trades), np.mean(wins) / (-np.mean(losses) + 1e-10)
                raw = min(1.0, max(0.0, rate - (1 - rate) / (pay + 1e-10))) / 2
                assert near(r["kelly_win_rate"], rate) and near(r["kelly_payoff"], pay)
                seen += 1
            us = [x[8] for x in own[max(0, i - 100) : i + 1]]
            size = 0.1 + 2.9 * raw * min(2.0, max(0.5, np.mean(us) / (us[-1] + 1e-10)))
            assert r["kelly_trades"] == len(trades) and near(r["kelly_size"], min(3.0, max(0.1, size)))
    assert seen > 100


def test_turning(spark):
    c = spark.createDataFrame([("a", 1, 5), ("a", 5, 9), ("a", 6, 7), ("a", 9, 12)], "symbol string, entry_seq long, exit_seq long")
    assert [r[1] for r in L.chain(c, turning=True).orderBy("entry_seq").collect()] == [1, 5, 9]
    assert [r[1] for r in L.chain(c).orderBy("entry_seq").collect()] == [1, 6, 9]
