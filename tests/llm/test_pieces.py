"""The sampler's kernels against plain loops."""

import math
import random

import numpy as np
import pytest

from tidewright.llm import pieces

ODD = ["the cats", "été à", "x日本y", "a\U0001f389b", "\x00\x01", "qzjqz", "don't-stop", "ab\ncd  ef"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.sampler(pieces.MODEL, 1.0).vocabulary


def edges_of(vocabulary, unit: bytes):
    """(start, end, log probability) of all pieces in a unit, and of the bytes of characters without a piece, by trying all spans."""
    by_raw = {vocabulary.raw[i]: float(p) for i, p in enumerate(vocabulary.log_p) if p > pieces.NEVER and not (len(vocabulary.raw[i]) == 1 and vocabulary.byte[vocabulary.raw[i][0]] == i)}
    text, out, at = unit.decode(), [], 0
    bounds = [0]
    for c in text:
        bounds.append(bounds[-1] + len(c.encode()))
        if c.encode() not in by_raw:
            out += [(i, i + 1, float(vocabulary.log_p[vocabulary.byte[unit[i]]])) for i in range(bounds[-2], bounds[-1])]
    longest = int(vocabulary.size.max())
    out += [(a, b, by_raw[unit[a:b]]) for a in bounds for b in bounds if a < b <= a + longest and unit[a:b] in by_raw]
    return out


def log_mass(vocabulary, unit: bytes) -> float:
    mass = [pieces.NEVER] * len(unit) + [0.0]
    edges = edges_of(vocabulary, unit)
    for at in range(len(unit) - 1, -1, -1):
        mass[at] = float(np.logaddexp.reduce([p + mass[b] for a, b, p in edges if a == at] or [pieces.NEVER]))
    return mass[0]


def test_masses_of_short_and_long_units(vocabulary):
    rng = random.Random(3)
    units = [t.encode() for t in ODD]
    units += ["".join(rng.choice("aeinrst é日\U0001f389-") for _ in range(n)).encode() for n in (1, 2, 3, 9, 15, 16, 20, 40, 300)]
    units += [b"x" * (vocabulary.short + d) for d in (-1, 0, 1)]
    lattices = pieces.Lattices(vocabulary, np.frombuffer(b"".join(units), np.uint8), np.concatenate([[0], np.cumsum([len(u) for u in units])]))
    assert np.allclose(lattices.mass, [log_mass(vocabulary, u) for u in units], rtol=0, atol=1e-9)
    assert [int(x) for x in np.diff(lattices.first)[lattices.end]] == [0] * len(units)
    assert len(lattices.piece) == sum(len(edges_of(vocabulary, u)) for u in units)


def test_steps_of_empty_texts_alone():
    s = pieces.sampler(pieces.MODEL, 1.0)
    for n in (1, 3):
        _, samples, kappa, _ = s.sample([b"%d" % i for i in range(n)], np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), 4)
        assert [len(own) for own in samples] == [1] * n and all(len(own[0].pieces) == 0 and own[0].log_p == 0 for own in samples)
        assert kappa == [pieces.NEVER] * n


def test_few_units_need_their_value(monkeypatch):
    """In a long text the values of some units at its start are worked out, not those of all its units."""
    text = ("the quick brown fox jumps over lazy dogs, and then it sleeps; " * 2_000).encode()
    units, seen, plain = text.count(b" "), [], pieces.leaving_values
    monkeypatch.setattr(pieces, "leaving_values", lambda *a: seen.append(len(a[0])) or plain(*a))
    data = np.frombuffer(text, np.uint8)
    _, samples, _, _ = pieces.sampler(pieces.MODEL, 1.0).sample([b"k"], data, np.array([0, len(data)]), 4)
    assert len({x.pieces.tobytes() for x in samples[0]}) == 4
    assert units > 20_000 and 0 < sum(seen) < 2_000


@pytest.mark.parametrize("top", [2, 5, 70])
def test_largest_values_are_found(top):
    rng = np.random.default_rng(top)
    sizes = np.array([0, 1, 3, 47, 48, 49, 400, 3_000])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    log_ps = np.where(rng.random(offs[-1]) < 0.9, 0.0, -rng.random(offs[-1]) / 5)  # masses fall slowly, many units have one path
    running, inside = np.concatenate([[0.0], np.cumsum(log_ps)]), pieces.ragged(sizes)
    prefix, seed = -rng.random(len(sizes)), rng.integers(0, 1 << 63, len(sizes)).astype(np.uint64)
    row, col, value = pieces.best_leaving(prefix, log_ps, running, offs, inside, seed, top)
    for t, n in enumerate(sizes):
        own = slice(offs[t], offs[t + 1])
        every = pieces.leaving_values(prefix[t] + running[own] - running[offs[t]], log_ps[own], pieces.uniform(seed[t], inside[own]))
        want = sorted(every[every > pieces.NEVER].tolist(), reverse=True)[:top]
        got = sorted(zip(value[row == t].tolist(), col[row == t].tolist()), reverse=True)
        assert np.allclose([v for v, _ in got[: len(want)]], want, rtol=0, atol=1e-9) and len(got) >= len(want)
        assert all(abs(every[i] - v) < 1e-9 for v, i in got)


def test_left_out_paths_and_their_probability(vocabulary):
    """All paths of a unit, drawn one after another: none twice, and their probabilities add up as told."""
    lattices = pieces.Lattices(vocabulary, np.frombuffer(b" cats", np.uint8), np.array([0, 5]))
    rng, seen, sums = random.Random(1), [], []
    found, _, log_p = lattices.walk(np.array([0]), np.array([7], np.uint64), 0, np.array([0]))
    seen.append(tuple(found.tolist()))
    total = math.exp(float(log_p[0]))
    while got := lattices.draw_other(0, seen, rng.random):
        seen.append(got[0])
        total += math.exp(got[1])
        sums.append((got[2], total))
    assert len(set(seen)) == len(seen) > 3 and abs(total - 1) < 1e-9
    assert all(abs(a - b) < 1e-9 for a, b in sums)


def test_round_trips_tell_wrong_pieces(vocabulary):
    texts = [t.encode() for t in ODD] + [b""]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    spaced, samples, _, _ = pieces.sampler(pieces.MODEL, 1.0).sample([b"%d" % i for i in range(len(texts))], data, starts, 3)
    at = starts + np.concatenate([[0], np.cumsum(np.diff(starts) > 0)])
    row, flat = np.repeat(np.arange(len(texts)), [len(x) for x in samples]), [x for own in samples for x in own]
    assert pieces.round_trips(vocabulary, flat, spaced, at, row).all()
    flat[1].pieces = flat[1].pieces[:-1]  # too short
    other = flat[4].pieces.copy()
    other[-1] = next(i for i in range(len(vocabulary.raw)) if vocabulary.size[i] == vocabulary.size[other[-1]] and vocabulary.raw[i] != vocabulary.raw[other[-1]])
    flat[4].pieces = other
    assert np.flatnonzero(~pieces.round_trips(vocabulary, flat, spaced, at, row)).tolist() == [1, 4]
