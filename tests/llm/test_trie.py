"""The prefix trie against a plain dictionary of prefixes, with and without bursts."""

import hashlib
import random
import re
import zlib

import pytest

from tidewright.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out, kids = {}, {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    for node in sorted(members, key=len, reverse=True):
        ms = sorted(members[node])
        below = kids.get(node, [])
        own = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(out[k][5] for k in below) or 1
        ends = ",".join(str(c) for c in ms if len(built[c]) == len(node))
        out[node] = (ms[0], len(node), min(members[node[:-1]]) if node else None, len(ms), len(below), leaves, own + sum(out[k][6] for k in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def ours(spark, rows, **kind):
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = P.trie(P.rebuilt(P.units(df)), **kind)
    got = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(map(tuple, got), key=lambda r: (r[1], r[0]))


def cases():
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(400), 150):
        long = rng.random() < 0.05
        for t in range(90 if long else rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "a", " ", "x\ty z"])))
    for c in range(500, 560):  # copies, and long ones that differ late
        rows += [(c, t, "user", f"same {t}") for t in range(3)]
    for c in range(600, 640):
        rows += [(c, t, "user", "again" if t < 80 else str(c % 7)) for t in range(82)]
    return rows


@pytest.mark.parametrize("kind", [{}, {"limit": 50}, {"limit": 1, "most_heads": 4}, {"limit": 3, "most_heads": 1 << 20}])
def test_nodes_equal_the_plain_ones(spark, kind):
    rows = cases()
    assert ours(spark, rows, **kind) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", "a"), (21, 0, "u", "a"), (None, 0, "u", "lost"), (2, 5, "u", ""), (2, 5, "u", ""), (2, 5, "v", "b c"), (40, 1, "user", "x" * 300_000), (43, 1, "use", "rx")]
    assert ours(spark, rows) == plain(rows)
    # unlike turns of like letters, and a conversation that loses all its turns, are told apart
    assert ours(spark, rows, limit=1) == plain(rows)


def test_empty(spark):
    assert ours(spark, []) == []


def test_ends_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 3)
    rows = [(c * 20, 0, "u", "one") for c in range(100)]
    assert ours(spark, rows, limit=4) == plain(rows)
