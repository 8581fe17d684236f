"""Plateaus, equity and walk-forward folds against plain versions; the balanced sample's shares."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ledgers as T
from tidewright.operators import regimes as G
from tidewright.operators import walkforward as X


def plain_plateau(cells, q):
    scores = sorted(cells.values())
    k = q * (len(scores) - 1)
    bound = scores[math.floor(k)] + (scores[min(math.floor(k) + 1, len(scores) - 1)] - scores[math.floor(k)]) * (k - math.floor(k))
    left, parts = {c for c, s in cells.items() if s >= bound}, []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            c = todo.pop()
            part.add(c)
            for i, d in itertools.product(range(len(c)), (-1, 1)):
                n = (*c[:i], c[i] + d, *c[i + 1 :])
                if n in left:
                    left.remove(n)
                    todo.append(n)
        parts.append(part)
    top = min(parts, key=lambda p: (-len(p), -max(cells[c] for c in p), min(p)))
    if len(top) == 1:
        return next(iter(top)), 1
    return tuple(round(sum(c[i] for c in top) / len(top)) for i in range(len(next(iter(top))))), len(top)


@pytest.mark.parametrize("shape", [(40,), (9, 7), (5, 4, 6)])
def test_plateau_center(spark, shape):
    rng = random.Random(len(shape))
    for q in (0.5, 0.8, 1.0):
        cells = {c: rng.random() for c in itertools.product(*map(range, shape))}
        axes = [f"x{i}" for i in range(len(shape))]
        df = spark.createDataFrame([(*c, s) for c, s in cells.items()], ", ".join(f"{a} long" for a in axes) + ", score double")
        got = G.plateau_center(df, axes, q=q).collect()[0]
        assert (tuple(got[a] for a in axes), got["cells"]) == plain_plateau(cells, q)


def curve(bars, trades, compounding, capital=100.0):
    out, done, dead = [], capital, False
    for seq, close in bars:
        now = [t for t in trades if t[1] == seq]
        for _, _, d, p, pnl, size in now:
            done = done * (1 + pnl * size) if compounding else done + capital * pnl * size
        value = done
        held = [t for t in trades if t[0] <= seq < t[1]]
        if held and not now:
            _, _, d, p, _, size = held[-1]
            value = done + (done if compounding else capital) * d * (close - p) / p * size
        dead = dead or value <= 0 or done <= 0
        out.append(0.0 if dead else value)
    return out


@pytest.mark.parametrize("compounding", [False, True])
def test_marked_equity(spark, compounding):
    rng, bars, trades = random.Random(4), {}, {}
    for s in "abcd":
        price, at = 10.0, 2
        bars[s], trades[s] = [], []
        for i in range(1, 80):
            price *= math.exp(rng.gauss(0, 0.4 if s in "cd" else 0.05))
            bars[s].append((i, price))
        while at < 70:
            end = at + rng.randint(1, 9)
            trades[s].append((at, end, rng.choice([1, -1]), bars[s][at - 1][1], rng.gauss(0, 0.6 if s == "d" else 0.1), rng.choice([1.0, 0.5])))
            at = end + rng.choice([0, 1, 3])
    b = spark.createDataFrame([(s, *x) for s in bars for x in bars[s]], "symbol string, seq long, close double")
    t = spark.createDataFrame([(s, *x) for s in trades for x in trades[s]], "symbol string, entry_seq long, exit_seq long, direction int, entry_price double, pnl double, size double")
    got = {(r["symbol"], r["seq"]): r["equity"] for r in T.marked_equity(b, t, 100.0, compounding=compounding, size="size").collect()}
    ended = 0
    for s in bars:
        want = curve(bars[s], trades[s], compounding)
        ended += want[-1] == 0
        assert all(abs(got[(s, i + 1)] - w) <= 1e-6 * max(1, abs(w)) for i, w in enumerate(want)), s
    assert ended


def test_walk_forward(spark):
    rng = random.Random(8)
    days = [f"2024-01-{d:02d}" for d in range(1, 31)]
    daily = [(s, e, d, rng.gauss(0.1 * e, 1), rng.randint(0, 3)) for s in "ab" for e in (1.0, 2.0, 3.0) for d in days]
    folds = [(s, f, days[5 * f], days[5 * f + 10], days[5 * f + 10], days[5 * f + 15]) for s in "ab" for f in range(3)]
    d = spark.createDataFrame(daily, "symbol string, entry double, day string, pnl double, trades int").withColumn("day", F.to_date("day"))
    f = spark.createDataFrame(folds, "symbol string, fold int, train_start string, train_end string, test_start string, test_end string")
    f = f.select("symbol", "fold", *[F.to_date(c).alias(c) for c in f.columns[2:]])
    got = {(r["symbol"], r["fold"]): r for r in X.walk_forward(d, f, ["entry"]).collect()}

    def sharpe(x):
        m = sum(x) / len(x)
        sd = math.sqrt(sum((v - m) ** 2 for v in x) / len(x))
        return m / sd * math.sqrt(365)

    for s, fold, a, b, _, z in folds:
        train = {e: sharpe([p for t, k, day, p, _ in daily if t == s and k == e and a <= day < b]) for e in (1.0, 2.0, 3.0)}
        best = max(train, key=lambda e: (train[e], -e))
        test = [(p, n) for t, k, day, p, n in daily if t == s and k == best and b <= day < z]
        r = got[(s, fold)]
        total = peak = fall = 0.0
        for p, _ in test:
            total += p
            peak, fall = max(peak, total), max(fall, max(peak, total) - total)
        assert r["entry"] == best and abs(r["train_sharpe"] - train[best]) < 1e-9 and abs(r["test_sharpe"] - sharpe([p for p, _ in test])) < 1e-9
        assert r["test_trades"] == sum(n for _, n in test) and abs(r["test_mdd"] - fall) < 1e-9


def test_balanced_sample(spark):
    rows = [("a" if i % 3 else "b", i, 0 if i < 9_000 else 1 if i < 10_000 else 2) for i in range(10_100)]
    df = spark.createDataFrame(rows, "symbol string, seq long, label int")
    one, two = ({(r[0], r[1]) for r in G.balanced_sample(df.repartition(n), "label", 500).select("symbol", "seq").collect()} for n in (1, 7))
    assert one == two  # a row is in or out by itself, however the table is cut
    n = {k: sum((s, i) in one for s, i, label in rows if label == k) for k in (0, 1, 2)}
    assert n[2] == 100 and all(abs(n[k] - 500) < 5 * math.sqrt(500) for k in (0, 1))
    assert G.balanced_sample(df, "label", 500, seed=1).count() != 0 and {(r[0], r[1]) for r in G.balanced_sample(df, "label", 500, seed=1).select("symbol", "seq").collect()} != one
