"""Pyramids, hybrid labels and patch masks against plain loops."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.operators import automata as A
from tidewright.operators import labels as L


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 1e-9 * max(1, abs(a))


@pytest.mark.parametrize("stop", [1.5, None])
def test_pyramid(spark, stop):
    rng, rows = random.Random(6), []
    for s in "abc":
        p = 50.0
        for i in range(1, 300):
            p *= math.exp(rng.gauss(0, 0.02))
            rows.append((s, i, p, rng.choice([None, 0]) if rng.random() < 0.05 else 1 if i // 40 % 2 else -1, rng.choice([None, 1e-4, 4e-4, 2e-4]), rng.choice([0.0, 0.5, 1.0, 1.0])))
    df = spark.createDataFrame(rows, "symbol string, seq long, close double, sig int, var double, size double").withColumn("stop", F.lit(1))
    got = {(r["symbol"], r["seq"]): r for r in A.pyramid(df, F.col("sig"), F.col("var"), F.col("size"), stop=stop).collect()}
    added = 0
    for s in "abc":
        held = None
        for _, i, close, sig, var, size in (r for r in rows if r[0] == s):
            sig, sd = sig or 0, None if var is None else math.sqrt(var)
            if held is None:
                if sig:
                    z = size if size > 0 else 1.0
                    held = {"side": sig, "prices": [(close, z)], "stop": None if stop is None or sd is None else close * math.exp(-sig * stop * sd)}
            else:
                side = held["side"]
                if sig != side or (held["stop"] is not None and side * (close - held["stop"]) <= 0):
                    held = None
                else:
                    total = sum(z for _, z in held["prices"])
                    if len(held["prices"]) < 3 and total < 3 and sd is not None and side * (close - held["prices"][-1][0] * math.exp(side * 1.5 * sd)) >= 0:
                        held["prices"].append((close, min(1.0, 3 - total)))
                        added += 1
                        if stop is not None:
                            mean = sum(p * z for p, z in held["prices"]) / sum(z for _, z in held["prices"])
                            held["stop"] = mean * math.exp(-side * stop * sd)
            r = got[(s, i)]
            if held is None:
                assert (r["position"], r["total_size"], r["stop"], r["entries"]) == (0, 0.0, None, 0)
            else:
                total = sum(z for _, z in held["prices"])
                assert r["position"] == held["side"] and r["entries"] == len(held["prices"]) and near(r["total_size"], min(3.0, total)) and near(r["stop"], held["stop"])
                assert near(r["average_entry"], sum(p * z for p, z in held["prices"]) / total)
    assert added > 20


def test_hybrid_labels(spark):
    rng, rows = random.Random(2), []
    for s in "ab":
        p, t = 10.0, datetime(2024, 1, 1)
        for i in range(1, 120):
            p *= math.exp(rng.gauss(0, 0.01))
            t += timedelta(hours=rng.choice([1, 2, 30, 60]))
            rows.append((s, i, t, p, rng.choice([None, 0.0, 0.005, 0.02, 0.05])))
    df = spark.createDataFrame(rows, "symbol string, seq long, bar_ts timestamp, close double, sg double")
    got = {(r["symbol"], r["seq"]): r for r in L.hybrid_labels(df, "sg", most=6).collect()}
    seen = set()
    for s in "ab":
        own = [r for r in rows if r[0] == s]
        for i, (_, seq, t, close, sg) in enumerate(own):
            limit = next((j for j in range(len(own)) if own[j][2] >= t + timedelta(hours=48)), len(own) - 1)
            end = min(limit, i + 6, len(own) - 1)
            if not sg or end <= i:
                assert (s, seq) not in got
                continue
            hit = next(((j, 1 if own[j][3] >= close * (1 + sg) else -1) for j in range(i, end + 1) if own[j][3] >= close * (1 + sg) or own[j][3] <= close * (1 - sg)), (end, 0))
            r = got[(s, seq)]
            assert (r["label"], r["exit_seq"]) == (hit[1], hit[0] + 1) and near(r["ret"], own[hit[0]][3] / close - 1)
            seen.add(r["label"])
    assert seen == {-1, 0, 1}


def test_patch_masks(spark):
    rows = [("a", i, [float(x) for x in range(1, 33)]) for i in range(20)] + [("b", 1, [1.0] * 30), ("b", 2, None), ("b", 3, [])]
    df = spark.createDataFrame(rows, "symbol string, seq long, x array<double>")
    got = {(r["symbol"], r["seq"]): r for r in L.patch_masks(df.repartition(3), "x", patch=4, ratio=0.4, seed=9).collect()}
    for s, i, x in rows[:20]:
        order = sorted(range(8), key=lambda p: hashlib.md5(f"9:{s}:{i}:{p}".encode()).hexdigest())
        hidden = sorted(order[:3])
        r = got[(s, i)]
        assert r["masked"] == hidden and r["x"] == [0.0 if k // 4 in hidden else v for k, v in enumerate(x)]
    assert len({tuple(got[("a", i)]["masked"]) for i in range(20)}) > 5
    assert all(got[("b", i)]["masked"] is None and got[("b", i)]["x"] is None for i in (1, 2, 3))
