"""Hard negatives against all scores computed one by one."""

import math
import random

import numpy as np
import pytest

from tidewright.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, embedding array<float>, pair int"


def plain(rows, every=100):
    known = {}
    for i, label, v, _ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known[(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = True
    out = []
    for i, label, v in known:
        if i % every:
            continue
        def score(w):
            return sum(a * b for a, b in zip(v, w))
        best = sorted({(-score(w), j) for j, m, w in known if m == label and j != i})[:5]
        for s, p in best:
            near = sorted({(-score(w), j) for j, m, w in known if m != label and 80 * -s <= 100 * score(w) <= 100 * -s})[:5]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(near)]
    return sorted(out)


def ours(spark, rows, **kind):
    return sorted(map(tuple, H.mine(spark.createDataFrame(rows, SCHEMA), **kind).collect()))


def cases(n=700, dims=11):
    rng = random.Random(9)
    same = [rng.uniform(-0.5, 0.5) for _ in range(dims)]
    rows = [(i, rng.randint(0, 3), [x if rng.random() < 0.5 else rng.uniform(-0.6, 0.6) for x in same], 0) for i in range(n)]
    rows += [(n + i, rng.randint(0, 3), same, 0) for i in range(40)]  # a group of ties
    rows += rows[100:130] + rows[0:1]  # repeats
    rows += [(100, 2, [0.1] * dims, 0), (None, 1, same, 0), (5000, None, same, 0), (5001, 1, None, 0), (5002, 1, [None] * dims, 0), (5003, 1, [float("nan")] * dims, 0), (5004, 2, [float("inf")] + same[1:], 0), (5005, 2, [], 0), (5006, 1, same[:3], 0)]
    return rows


@pytest.mark.parametrize("kind", [{}, {"anchors_in": 2, "candidates_in": 50}])
def test_equals_all_scores(spark, monkeypatch, kind):
    monkeypatch.setattr(H, "BATCH", 64)
    monkeypatch.setattr(H, "TABLES", 3)
    rows = cases()
    want = plain(rows)
    assert len(want) > 50 and ours(spark, rows, **kind) == want


def test_scores_are_inner_products():
    rng = np.random.default_rng(1)
    for bits, number in ((2, np.int32), (9, np.int32), (20, np.int64)):
        a = rng.integers(-(1 << bits - 1), 1 << bits - 1, (7, 24)).astype(number)
        b = rng.integers(-(1 << bits - 1), 1 << bits - 1, (50, 24))
        assert (H.scores(H.subset_sums(a), H.planes(b, bits)) == b @ a.T.astype(np.int64)).all()


def test_wide_components_and_refusal(spark):
    rows = [(i, i % 2, [1e4 * math.sin(i), 3e4 * math.cos(i)], 0) for i in range(300)]
    assert ours(spark, rows) == plain(rows) != []
    with pytest.raises(ValueError):
        ours(spark, [(0, 1, [1e30], 0)])


def test_empty(spark):
    assert ours(spark, []) == [] and ours(spark, [(1, 1, [0.5], 0)]) == []
