"""Stops, filters, state machines and hidden Markov models against plain loops and enumeration."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import automata as A
from tidewright.operators import filters as K
from tidewright.operators import hmm as H

BARS = "symbol string, seq long, open double, high double, low double, close double, duration double"


def some_bars(n=120, symbols=("a", "b"), holes=(), seed=1):
    rng, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for i in range(1, n + 1):
            o, price = price, price * math.exp(rng.gauss(0, 0.02))
            top, low = max(o, price) * (1 + rng.random() * 0.01), min(o, price) * (1 - rng.random() * 0.01)
            rows.append((s, i, o, top, low, price, rng.choice([600.0, 3600.0, 50_000.0])) if i not in holes else (s, i, None, None, None, None, 1200.0))
    return rows


def close_to(a, b):
    return (a is None or a != a) and (b is None or b != b) or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))


# ---- stops ----


def stops_plain(rows):
    """rows: high, low, close, enter, width, k, mae, broken, left (the same for both sides)."""
    out, pos = [], None
    for seq, (high, low, close, enter, width, k, mae, broken, left) in enumerate(rows, 1):
        if pos is None:
            if not enter or k is None or mae is None:
                out.append((0, None, None, None, None))
                continue
            hard = close * math.exp(-enter * mae)
            best = high if enter > 0 else low
            pos = {"side": enter, "since": seq, "best": best, "hard": hard, "k": k, "trail": hard if width is None else best * math.exp(-enter * k * width)}
            out.append((enter, seq, max(pos["trail"], hard) if enter > 0 else min(pos["trail"], hard), None, None))
            continue
        s = pos["side"]
        pos["best"] = max(pos["best"], high) if s > 0 else min(pos["best"], low)
        if width is not None:
            level = pos["best"] * math.exp(-s * pos["k"] * width)
            pos["trail"] = max(pos["trail"], level) if s > 0 else min(pos["trail"], level)
        touched = low if s > 0 else high
        why = next((w for w, hit in (("hard", s * (touched - pos["hard"]) < 0), ("trail", s * (touched - pos["trail"]) < 0), ("break", broken), ("signal", left)) if hit), None)
        if why:
            price = pos[why] if why in ("hard", "trail") else None
            out.append((0, pos["since"], price, why, price))
            pos = None
        else:
            out.append((s, pos["since"], max(pos["trail"], pos["hard"]) if s > 0 else min(pos["trail"], pos["hard"]), None, None))
    return out


def test_trailing_stop(spark):
    rng = random.Random(7)
    data = {}
    for s in ("a", "b", "c"):
        rows = []
        for _, _, _, high, low, close, _ in some_bars(300, (s,), seed=ord(s)):
            rows.append((high, low, close, rng.choice([0, 1, 1, -1, -1]), rng.choice([None, 0.01, 0.02, 0.05]), rng.choice([None, 0.5, 1.0, 2.0]), rng.choice([None, 0.01, 0.05]), rng.random() < 0.05, rng.random() < 0.05))
        # bars on which the hard stop, the trail and both signals hold at once, and one that leaves by each in turn
        rows += [(101.0, 99.0, 100.0, 1, 0.01, 1.0, 0.02, False, False), (110.0, 90.0, 95.0, -1, 0.01, 1.0, 0.02, True, True), (101.0, 99.0, 100.0, 1, 0.001, 1.0, 0.5, False, False), (110.0, 90.0, 95.0, 1, 0.01, 1.0, 0.02, True, True)]
        rows += [(101.0, 100.0, 100.5, 1, 1.0, 1.0, 0.5, False, False), (101.0, 100.0, 100.5, 1, 1.0, 1.0, 0.5, True, True), (101.0, 100.0, 100.5, -1, 1.0, 1.0, 0.5, False, False), (101.0, 100.0, 100.5, 1, 1.0, 1.0, 0.5, False, True)]
        data[s] = rows
    flat = [(s, i, *r) for s, rows in data.items() for i, r in enumerate(rows, 1)]
    df = spark.createDataFrame(flat, "symbol string, seq long, high double, low double, close double, enter int, width double, k double, mae double, broken boolean, left boolean")
    got = A.trailing_stop(df.repartition(5), F.col("enter"), F.col("width"), *[F.col("k")] * 2, *[F.col("mae")] * 2, *[F.col("broken")] * 2, *[F.col("left")] * 2)
    found = {(r["symbol"], r["seq"]): (r["position"], r["entry_seq"], r["stop"], r["reason"], r["exit_price"]) for r in got.collect()}
    reasons = set()
    for s, rows in data.items():
        for i, want in enumerate(stops_plain(rows), 1):
            have = found[(s, i)]
            assert have[:2] == want[:2] and have[3] == want[3] and close_to(have[2], want[2]) and close_to(have[4], want[4]), (s, i, have, want)
            reasons.add(want[3])
    assert reasons == {None, "hard", "trail", "break", "signal"}
    trades = A.stop_trades(got).collect()
    assert len(trades) == sum(w[3] is not None for rows in data.values() for w in stops_plain(rows))
    assert all(t["exit_seq"] > t["entry_seq"] for t in trades)


def test_empty_bars(spark):
    df = spark.createDataFrame([], BARS)
    assert K.adaptive_filter(df).count() == 0 and K.acceleration_filter(df).count() == 0
    assert A.state_machine(df, [F.lit(0)], "s").count() == 0
    assert A.mode_switch(df, F.lit("x"), F.lit(1.0)).count() == 0


# ---- state machines ----


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_state_machine(spark, block):
    rng = random.Random(block)
    rows = [(s, i, *[rng.choice([None, 0, 1, 2, 3, 4]) for _ in range(5)]) for s in "abc" for i in range(1, 41)]
    df = spark.createDataFrame(rows, "symbol string, seq long, m0 int, m1 int, m2 int, m3 int, m4 int")
    got = {(r["symbol"], r["seq"]): r["s"] for r in A.state_machine(df, [F.col(f"m{i}") for i in range(5)], "s", start=2, block=block).collect()}
    assert len(got) == len(rows)
    state = {}
    for s, i, *moves in rows:
        now = state.get(s, 2)
        state[s] = now if moves[now] is None else moves[now]
        assert got[(s, i)] == state[s]


def test_mode_switch(spark):
    rng = random.Random(2)
    rows = [(s, i, rng.choice(["x", "x", "y", "z", None]), rng.choice([None, 0.2, 0.6, 0.9, 0.9])) for s in "ab" for i in range(1, 200)]
    rows += [("c", i, "x" if i < 3 else "y", 0.9) for i in range(1, 20)]  # a run that waits for the cooldown
    df = spark.createDataFrame(rows, "symbol string, seq long, mode string, p double")
    got = sorted((r["symbol"], r["seq"], r["from_mode"], r["to_mode"], r["bars_since"]) for r in A.mode_switch(df, F.col("mode"), F.col("p")).collect())
    want, now, last = [], {}, {}
    for s, i, mode, p in rows:
        if mode is None:
            continue
        if s not in now or (mode != now[s] and p is not None and p >= 0.6 and i - last[s] >= 5):
            want.append((s, i, now.get(s), mode, i - last[s] if s in last else None))
            now[s], last[s] = mode, i
    assert got == sorted(want)
    held = {(r["symbol"], r["seq"]): r["mode"] for r in A.in_force(df.drop("mode"), A.mode_switch(df, F.col("mode"), F.col("p"))).collect()}
    assert held[("c", 5)] == "x" and held[("c", 6)] == "y"


# ---- filters ----


def adaptive_plain(bars, hours):
    """The filter in matrices, bar by bar."""
    typ = [None if b[3] is None else (b[3] + b[4] + b[5]) / 3 for b in bars]
    y = [math.nan if t is None else math.log(t) for t in typ]
    spread = [math.nan if b[3] is None else math.log(b[3]) - math.log(b[4]) for b in bars]
    x, p, vs, nis, begun, out = np.zeros(2), np.eye(2), [], None, False, []
    for i, z in enumerate(y):
        if z != z and not begun:
            out.append({})
            continue
        if not begun:
            x, begun = np.array([z, 0.0]), True
        lo = max(0, i - 19)
        recent = np.array(vs[lo:])
        q = 1e-10
        if i > 0 and len(recent) >= 2:
            factor = 1.0 if len(recent) < 3 else 1 + 2 * np.abs(np.diff(recent[-3:])).mean() / (np.abs(recent).mean() + 1e-10)
            q = max(np.var(recent) * 0.4 * factor, 1e-10)
        boost = 1.0 if nis is None else max(1.0, min(nis * 3.0, 20.0))
        dt = hours[i]
        f = np.array([[1, dt], [0, 1]])
        noise = np.maximum(q * 0.4 * boost * np.array([[dt**4 / 4, dt**3 / 2], [dt**3 / 2, dt**2]]), 1e-10)
        x, p = f @ x, f @ p @ f.T + noise
        row = {"kf_trend_pred": math.exp(x[0]), "kf_uncertainty_pred": p[0, 0], "kf_gain": 0.0}
        if z == z:
            seen = [v for v in y[lo : i + 1] if v == v]
            ranges = [v for v in spread[lo : i + 1] if v == v]
            rt = 1.0 if i == 0 or len(seen) < 2 else max(np.var(np.diff(seen)), 1e-8)
            rr = 1.0 if i == 0 or len(ranges) < 2 else max(np.mean(np.square(ranges)) / (4 * math.log(2)), 1e-8)
            e, s, risk = z - x[0], p[0, 0] + rt, p[0, 0] + rr
            gain = p[:, 0] / s
            nis = e * e / s
            x = x + gain * e
            p = p - np.outer(gain, p[0])
            row |= {"kf_gain": gain[0], "kf_innovation_cov": s, "kf_innovation_cov_risk": risk, "kf_innovation": e, "kf_nis": nis, "kf_nis_boost": boost, "kf_r_trend": rt, "kf_r_risk": rr, "kf_std_innovation": e / (math.sqrt(s) + 1e-10), "kf_stop_distance": 3 * math.sqrt(risk)}
        vs.append(x[1])
        row |= {"kf_trend": math.exp(x[0]), "kf_velocity": x[1], "kf_velocity_var": p[1, 1], "kf_uncertainty": p[0, 0], "kf_velocity_zscore": x[1] / (math.sqrt(p[1, 1]) + 1e-10)}
        if typ[i] is not None:
            row |= {"kf_deviation": typ[i] - row["kf_trend"], "kf_deviation_pct": (typ[i] - row["kf_trend"]) / (row["kf_trend"] + 1e-10) * 100}
        out.append(row)
        near = [r["kf_deviation"] for r in out[max(0, i - 19) :] if "kf_deviation" in r]
        if len(near) >= 5 and "kf_deviation" in row:
            row["kf_signal"] = row["kf_deviation"] / (np.std(near, ddof=1) + 1e-10)
    return out


@pytest.mark.parametrize("holes", [(), (1, 2, 3, 30, 31, 60)])
def test_adaptive_filter(spark, holes):
    bars = some_bars(100, holes=holes)
    df = spark.createDataFrame(bars, BARS)
    got = {(r["symbol"], r["seq"]): r for r in K.adaptive_filter(df, F.col("duration") / 3600).collect()}
    for s in "ab":
        own = [b for b in bars if b[0] == s]
        for b, want in zip(own, adaptive_plain(own, [b[6] / 3600 for b in own])):
            have = got[(s, b[1])]
            assert all(close_to(have[c], want.get(c)) for c in K.COLUMNS2), [(c, have[c], want.get(c)) for c in K.COLUMNS2]
    assert len(K.COLUMNS2) == 20 and K.adaptive_filter(df).where("kf_trend IS NULL").count() == (6 if holes else 0)


def test_directional_boost(spark):
    df = spark.createDataFrame(some_bars(40), BARS)
    boosts = [r[0] for r in K.adaptive_filter(df, nis_weight=None, directional=0.5).orderBy("symbol", "seq").select("kf_nis_boost").collect()]
    shifts = [r[0] for r in K.adaptive_filter(df, nis_weight=None, directional=0.5).orderBy("symbol", "seq").select("kf_std_innovation").collect()]
    for i in [*range(1, 40), *range(41, 80)]:
        assert close_to(boosts[i], min(max(math.exp(-0.5 * shifts[i - 1]), 0.2), 5.0))


@pytest.mark.parametrize("holes", [(), (1, 2, 40)])
def test_acceleration_filter(spark, holes):
    bars = some_bars(80, holes=holes)
    got = {(r["symbol"], r["seq"]): r for r in K.acceleration_filter(spark.createDataFrame(bars, BARS)).collect()}
    f = np.array([[1, 1, 0.5], [0, 1, 1], [0, 0, 1]])
    for s in "ab":
        x, p, past, begun, seen = np.zeros(3), np.eye(3), [], False, []
        for i, b in enumerate(b for b in bars if b[0] == s):
            have = got[(s, b[1])]
            z = math.nan if b[3] is None else math.log((b[3] + b[4] + b[5]) / 3)
            seen.append(z)
            if z != z and not begun:
                assert have["kf_trend"] is None
                continue
            if not begun:
                x, begun = np.array([z, 0.0, 0.0]), True
            raised = max(1.0, 10 * np.var(past[-20:])) if len(past) > 1 else 1.0
            x, p = f @ x, f @ p @ f.T + 1e-10 * np.diag([0.01, 0.1 * raised, raised])
            gain = e = s_ = None
            if z == z:
                near = [v for v in seen[max(0, i - 19) :] if v == v]
                rt = 1.0 if i == 0 or len(near) < 2 else max(np.var(np.diff(near)), 1e-8)
                e, s_ = z - x[0], p[0, 0] + rt
                k = p[:, 0] / s_
                x, p, gain = x + k * e, p - np.outer(k, p[0]), k[0]
            past.append(x[2])
            want = {"kf_trend": math.exp(x[0]), "kf_velocity": x[1], "kf_acceleration": x[2], "kf_uncertainty": p[0, 0], "kf_gain": gain, "kf_innovation": e, "kf_std_innovation": None if e is None else e / (math.sqrt(s_) + 1e-10)}
            assert all(close_to(have[c], want[c]) for c in want), (b[1], [(c, have[c], want[c]) for c in want])


def test_excursion_multiples(spark):
    bars = some_bars(60, ("a",))
    df = spark.createDataFrame(bars, BARS).withColumn("w", F.when(F.col("seq") != 20, F.col("duration") / 1e6))
    got = {r["seq"]: r for r in K.excursion_multiples(df, F.col("w"), horizon=3, window=20, q=0.9, least=5).collect()}
    moves = {}
    for i in range(57):
        low, high = min(b[4] for b in bars[i + 1 : i + 4]), max(b[3] for b in bars[i + 1 : i + 4])
        w = None if 20 in range(i + 2, i + 5) else np.mean([b[6] / 1e6 for b in bars[i + 1 : i + 4]])
        moves[i] = (math.log(bars[i][2] / low), math.log(high / bars[i][2]), w)
    for t in range(60):
        past = [moves[i] for i in range(max(0, t - 23), t - 3) if i in moves] if t >= 24 else []
        for side, name in ((0, "long"), (1, "short")):
            assert close_to(got[t + 1][f"mae_{name}"], np.percentile([m[side] for m in past], 90) if len(past) >= 5 else None)
            ks = [m[side] / m[2] for m in past if m[2] is not None]
            assert close_to(got[t + 1][f"k_{name}"], np.percentile(ks, 90) if len(ks) >= 5 else None)


# ---- hidden Markov models ----


def enumerated(x, model):
    """Posteriors, filtered probabilities, likeliest path and log likelihood by all paths."""
    density = np.exp(model.log_density(np.array(x)))
    k, n = len(model.pi), len(x)
    weights = {}
    for path in itertools.product(range(k), repeat=n):
        p = model.pi[path[0]] * density[0, path[0]]
        for t in range(1, n):
            p *= model.moves[path[t - 1], path[t]] * density[t, path[t]]
        weights[path] = p
    total = sum(weights.values())
    smooth = np.array([[sum(w for q, w in weights.items() if q[t] == s) / total for s in range(k)] for t in range(n)])
    return smooth, max(weights, key=weights.get), math.log(total)


def a_model(k=3):
    rng = np.random.default_rng(4)
    moves = rng.random((k, k)) + np.eye(k)
    return H.Model(np.full(k, 1 / k), moves / moves.sum(1, keepdims=True), rng.normal(size=(k, 2)), np.stack([np.eye(2) * (i + 1) / 2 for i in range(k)]))


@pytest.mark.parametrize("size", [2, 3, 512])
def test_decode_equals_enumeration(spark, size):
    rng = np.random.default_rng(size)
    series = {s: rng.normal(size=(n, 2)) for s, n in (("a", 8), ("b", 1), ("c", 6))}
    rows = [(s, i + 1, float(v[0]), float(v[1])) for s, x in series.items() for i, v in enumerate(x)] + [("a", 9, None, 1.0)]
    df, model = spark.createDataFrame(rows, "symbol string, seq long, x1 double, x2 double"), a_model()
    got = {(r["symbol"], r["seq"]): r for r in H.decode(df, ["x1", "x2"], model, size).collect()}
    assert len(got) == 15
    for s, x in series.items():
        smooth, path, _ = enumerated(x, model)
        for t in range(len(x)):
            r, past = got[(s, t + 1)], enumerated(x[: t + 1], model)[0][-1]
            assert r["path"] == path[t] and r["smoothed"] == smooth[t].argmax() and close_to(r["p_smoothed"], smooth[t].max())
            assert r["filtered"] == past.argmax() and close_to(r["p_filtered"], past.max())


def test_fit(spark):
    rng = np.random.default_rng(11)
    rows, means = [], [(-2.0, 0.0), (0.0, 1.0), (2.0, -1.0)]
    for s in ("a", "b"):
        for i in range(400):
            state = i // 33 % 3
            rows.append((s, i + 1, *(float(v) for v in rng.normal(means[state], 0.4))))
    df = spark.createDataFrame(rows, "symbol string, seq long, x1 double, x2 double")
    model = H.fit(df, ["x1", "x2"], iterations=12, tolerance=-1.0, ridge=0.0, size=64)
    assert len(model.log_likelihood) == 12
    assert all(b >= a - 1e-6 for a, b in zip(model.log_likelihood, model.log_likelihood[1:]))
    assert np.abs(np.sort(model.means[:, 0]) - [-2, 0, 2]).max() < 0.15 and (np.diag(model.moves) > 0.9).all()
    assert sorted(model.names()) == ["bear", "bull", "sideways"] and model.names()[int(model.means[:, 0].argmax())] == "bull"
    # the likelihood is that of all paths, and one step doesn't depend on how a series is cut
    short = df.where("seq <= 7")
    one = H.fit(short, ["x1", "x2"], iterations=2, tolerance=-1.0, size=2, model=a_model())
    two = H.fit(short, ["x1", "x2"], iterations=2, tolerance=-1.0, size=512, model=a_model())
    by = {s: np.array([r[2:] for r in rows if r[0] == s and r[1] <= 7]) for s in "ab"}
    assert close_to(one.log_likelihood[0], sum(enumerated(x, a_model())[2] for x in by.values()))
    assert np.allclose(one.means, two.means) and np.allclose(one.moves, two.moves) and np.allclose(one.covs, two.covs) and np.allclose(one.pi, two.pi)
    with pytest.raises(ValueError):
        H.fit(df.where("seq < 0"), ["x1", "x2"], model=a_model())
