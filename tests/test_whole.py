"""The registered market queries over all their input, at the surveyed defaults; expected values are worked out here."""

import math
import random

import duckdb
import numpy as np
import pytest

from tidewright.operators import labels as L
from tidewright.operators import windows as W
from tidewright.plans import catalog
from tidewright.sources import market as M

SF = "/root/testdata/sf0.001"


def test_ffill_reads_every_order(spark):
    got = {(r["symbol"], r["day"]): r["value"] for r in catalog.QUERIES["join_asof_ffill"](spark, SF).collect()}
    orders = duckdb.sql(f"SELECT o_orderpriority, CAST(o_orderdate AS DATE), sum(o_totalprice) FROM '{SF}/orders.parquet' GROUP BY 1, 2").fetchall()
    daily = {(s, day): v for s, day, v in orders}
    days, series = sorted({day for _, day in daily}), {s for s, _ in daily}
    assert set(got) == {(s, day) for s in series for day in days}
    for s in series:
        value = 100000.0
        for day in days:
            value = daily.get((s, day), value)
            assert got[s, day] == pytest.approx(value, abs=1e-3)


@pytest.fixture(scope="module")
def bars(spark):
    out = {}
    for r in M.bars(spark, SF).orderBy("symbol", "seq").collect():
        out.setdefault(r["symbol"], []).append(r)
    return out


def rising(spark, n):
    rng = random.Random(3)
    rows, close = [], 100.0
    for i in range(n):
        close *= math.exp(rng.gauss(0, 0.01))
        rows.append(("a", i + 1, close * (1 + abs(rng.gauss(0, 0.005))), close * (1 - abs(rng.gauss(0, 0.005))), close, abs(rng.gauss(0.004, 0.002))))
    return rows, spark.createDataFrame(rows, "symbol string, seq long, high double, low double, close double, sigma double").repartition(3)


def test_fracdiff_takes_every_lag_of_the_default(spark):
    weights = [1.0]
    while abs(w := -weights[-1] * (0.4 - len(weights) + 1) / len(weights)) >= 1e-5:
        weights.append(w)
    assert len(weights) == 1458
    rows, df = rising(spark, 3200)
    logs = [math.log(r[4]) for r in rows]
    got = {r["seq"]: r["fracdiff"] for r in W.fracdiff(df).collect()}
    strict = {r["seq"]: r["fracdiff"] for r in W.fracdiff(df, strict=True).collect()}
    assert len(got) == 3200 and [s for s in strict if strict[s] is not None] and min(s for s in strict if strict[s] is not None) == 1458
    for i in (0, 1, 11, 1456, 1457, 1458, 1459, 2915, 2916, 3199):
        assert got[i + 1] == pytest.approx(sum(w * logs[i - k] for k, w in enumerate(weights) if k <= i), abs=1e-9)


def test_fracdiff_query(spark, bars):
    weights = W.fracdiff_weights(0.4, 1e-5)
    got = {(r["symbol"], r["seq"]): r["fracdiff"] for r in catalog.QUERIES["win_fracdiff"](spark, SF).collect()}
    assert len(got) == sum(map(len, bars.values()))
    for s, own in bars.items():
        for i in range(len(own)):
            assert got[s, i + 1] == pytest.approx(sum(w * math.log(own[i - k]["close"]) for k, w in enumerate(weights) if k <= i), abs=2e-6)


def test_trend_scan_tries_every_window(spark, bars):
    got = {(r["symbol"], r["seq"]): r for r in catalog.QUERIES["lab_trend_scan"](spark, SF).collect()}
    assert len({r["window"] for r in got.values()} - set(range(20, 101, 10))) > 1
    for s, own in bars.items():
        y = np.log([r["close"] for r in own])
        for i in range(len(y) - 19):
            best = max((abs(t), -n, t) for n in range(20, min(100, len(y) - i) + 1) for t in [slope_t(y[i : i + n])])
            assert got[s, i + 1]["window"] == -best[1] and got[s, i + 1]["t_value"] == pytest.approx(best[2], abs=1e-4)


def slope_t(y):
    x = np.arange(len(y)) - (len(y) - 1) / 2
    slope = (x @ y) / (x @ x)
    rest = y - y.mean() - slope * x
    return slope / math.sqrt((rest @ rest) / (len(y) - 2) / (x @ x))


def test_threshold_sweep_tries_all_ten(spark, bars):
    got = {(r["symbol"], round(r["threshold"], 9)): (r["n"], r["total"]) for r in catalog.QUERIES["agg_threshold_sweep"](spark, SF).collect()}
    expected = {}
    for s, own in bars.items():
        ranked = sorted(own, key=lambda r: (r["volume"], r["seq"]))
        p = {r["seq"]: i / (len(own) - 1) for i, r in enumerate(ranked)}
        for th in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95):
            f = [own[r["seq"]]["close"] / r["close"] - 1 for r in own[:-1] if p[r["seq"]] >= th]
            expected[s, th] = (len(f), sum(f))
    assert set(got) == set(expected)
    for key, (n, total) in expected.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(total, abs=2e-6)


def test_momentum_has_all_windows(spark, bars):
    df = catalog.QUERIES["win_momentum_z"](spark, SF)
    assert df.columns == ["symbol", "seq", "mom_z_10", "mom_z_50", "mom_z_250", "mom_z_1000"]
    for r in df.collect():
        close = [x["close"] for x in bars[r["symbol"]][: r["seq"]]]
        ret = [0.0] + [b / a - 1 for a, b in zip(close, close[1:])]
        for n in (10, 50, 250, 1000):
            if len(close) <= n:
                assert r[f"mom_z_{n}"] is None
            else:
                assert r[f"mom_z_{n}"] == pytest.approx((close[-1] / close[-1 - n] - 1) / (np.std(ret[-n:], ddof=1) * math.sqrt(n) + 1e-10), abs=1e-4)


def test_touch_grid_equals_first_touch_at_each_point(spark):
    rows, df = rising(spark, 60)
    grid = {(r["seq"], r["sl"], r["pt"], r["horizon"]): r["label"] for r in L.touch_grid(df, "sigma", [0.5, 1.0], [0.4, 1.5], [5, 20]).collect()}
    expected = {}
    for sl in (0.5, 1.0):
        for pt in (0.4, 1.5):
            for h in (5, 20):
                for r in L.first_touch(df, "sigma", pt, sl, h).collect():
                    expected[r["seq"], sl, pt, h] = r["label"]
    assert grid == expected and len(set(grid.values())) == 3


def test_grid_query_has_every_point(spark):
    got = catalog.QUERIES["lab_grid"](spark, "/root/testdata/sf0.01").collect()
    points = {(r["sl"], r["pt"], r["horizon"]) for r in got}
    longest = max(r["n"] for r in M.bars(spark, "/root/testdata/sf0.01").groupBy("symbol").count().withColumnRenamed("count", "n").collect())
    assert points == {(sl, pt, h) for sl in (1.0, 2.0, 3.0) for pt in (1.5, 2.0, 2.5, 3.0, 3.5) for h in (50, 100, 200, 500, 1000) if h < longest}
