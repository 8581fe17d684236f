"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

The vocabulary is that of a given SentencePiece model with byte fallback. A piece's log probability follows its rank in
the vocabulary (Zipf's law, `-log(rank + OFFSET)`, normalised), divided by the temperature; bytes of characters without
a piece rank last. A text's lattice has an edge for each piece that matches; as no piece crosses the end of a word, it is
a chain of the lattices of its units (a run of spaces with the word after it, or a line end).

Sampling is a best-first search over perturbed log probabilities. The root has a Gumbel value; a node's best child keeps
its value, the mass of the other children gets a Gumbel value truncated at it. Popping the largest value again and again
yields distinct segmentations as Gumbel top-k does, which is sampling without replacement. Children are drawn lazily: a
frontier entry stands for "all segmentations that follow a sample up to unit t and differ there". Random numbers are
hashes of the row's key and of what they are for, so a retried or re-partitioned task repeats them.

Lattices, and the paths through all units of a step's texts, are computed with numpy; lattices of units stay in a table
of bounded size in each Python worker.

For each sample: its log probability, its perturbed value, and the log inclusion score log(1 - exp(-exp(log p - kappa))),
where kappa is the (k+1)-th value; it is 0 where the text has k segmentations or fewer.

Defined cases: null and empty texts have one segmentation without pieces; equal keys with equal texts give equal samples;
texts with fewer than k segmentations give all of them, each once; a text of any length is taken whole. Encoding is lossless: the dummy space that the model
puts before a text is removed on decoding.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Spans, mix, ragged, steps, table

SAMPLES, TEMPERATURE, OFFSET, KNOWN_UNITS, KNOWN_EDGES = 4, 1.0, 2.7, 150_000, 3_000_000
#: Units longer than this are worked through one by one.
LONG = 512
#: The given model, unless the environment names another.
MODEL = os.environ.get("TIDEWRIGHT_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
NEVER = -math.inf
_U = np.uint64


def uniform_seed(seed, *what) -> np.ndarray:
    """What uniform(seed, *what, ...) goes on from."""
    x = np.asarray(seed, np.uint64)
    with np.errstate(over="ignore"):
        for w in what:
            x = mix(x * _U(0x9E3779B97F4A7C15) + np.asarray(w, np.uint64) + _U(1))
    return x


def uniform(seed, *what) -> np.ndarray:
    """Numbers in (0, 1) that depend on the seed and on each of `what` (integers or arrays of them)."""
    return ((uniform_seed(seed, *what) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def leaving_values(before, log_ps, u) -> np.ndarray:
    """Gumbel values of "as drawn up to a unit (log probability `before`), and different there (not by the path of log_ps)"."""
    with np.errstate(divide="ignore"):
        return before + np.log(-np.expm1(np.minimum(log_ps, 0.0))) - np.log(-np.log(u))


#: So many units of each text get their Gumbel values first.
HEAD = 48


def best_leaving(prefix, log_ps, running, offs, inside, seed, most: int):
    """The largest `most` (or more) Gumbel values of "as drawn up to a unit, and different there" of each text: texts, units (from the first drawn one on), values.

    A value is the log mass of those segmentations plus a random number. The masses fall along a text, so few units
    beyond the first ones can come up; they are told by their uniform numbers u, as -log(-log u) <= -log(1 - u).
    """
    sizes, rows = np.diff(offs), len(offs) - 1
    before = prefix - running[offs[:-1]]
    wide = max(HEAD, most)
    first = np.minimum(sizes, wide)
    row, col = np.repeat(np.arange(rows), first), ragged(first)
    table = np.full((rows, wide), NEVER)
    at = offs[:-1][row] + col
    table[row, col] = leaving_values(before[row] + running[at], log_ps[at], uniform(seed[row], inside[at]))
    top = np.argpartition(-table, most - 1, axis=1)[:, :most]
    found = np.take_along_axis(table, top, 1)
    least = found.min(axis=1)
    row, col, value = np.repeat(np.arange(rows), most), top.ravel(), found.ravel()
    later = sizes - first
    if later.any():
        row2 = np.repeat(np.arange(rows), later)
        at = (offs[:-1] + first)[row2] + ragged(later)
        u = uniform(seed[row2], inside[at])
        with np.errstate(over="ignore"):
            # first by the mass where the rest of the text begins, which is one number a text, then by the unit's own
            room = np.exp(before + running[offs[:-1] + first] - least) * (1 + 1e-9)
            may = np.flatnonzero(1.0 - u <= room[row2])
            row2, at, u = row2[may], at[may], u[may]
            may = np.flatnonzero(1.0 - u <= np.exp(before[row2] + running[at] - least[row2]) * (1 + 1e-9))
            row2, at, u = row2[may], at[may], u[may]
        more = leaving_values(before[row2] + running[at], log_ps[at], u)
        row, col, value = np.concatenate([row, row2]), np.concatenate([col, at - offs[:-1][row2]]), np.concatenate([value, more])
    on = np.flatnonzero((value > NEVER) & (value >= least[row]))
    return row[on], col[on], value[on]


_MASK = (1 << 64) - 1


def uniform_one(seed: int, *what: int) -> float:
    """uniform() of single integers."""
    x = seed
    for w in what:
        x = (x * 0x9E3779B97F4A7C15 + w + 1) & _MASK
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        x ^= x >> 31
    return ((x >> 11) + 0.5) / (1 << 53)


_U8_PIECE, _U8_BEGINS = np.uint8(1), np.uint8(2)


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers that tell spans of one length, of one or two bytes, apart."""
    x = data[starts].astype(np.uint64)
    return x if not len(x) or ends[0] - starts[0] == 1 else x << _U(8) | data[starts + 1]


class Vocabulary:
    """The pieces of a model as bytes, by length and hash, with their log probabilities."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.raw: list[bytes] = [b""] * n
        self.byte = np.zeros(256, np.int32)
        log_p = np.full(n, NEVER)
        by_length: dict[int, list[int]] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw[i] = bytes([int(piece[3:5], 16)])
                self.byte[self.raw[i][0]] = i
                log_p[i] = -math.log(n + OFFSET)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = piece.replace("▁", " ").encode()
                by_length.setdefault(len(self.raw[i]), []).append(i)
                log_p[i] = -math.log(i + OFFSET)
        self.log_p = (log_p - np.logaddexp.reduce(log_p)) / temperature
        self.p = np.exp(self.log_p)
        # a path through this many bytes has a probability that a double holds with full precision
        self.short = int(min(LONG, 700 / max(1.0, -self.log_p[self.log_p > NEVER].min(initial=-1.0))))
        self.size = np.array([len(x) for x in self.raw])
        self.joins = np.zeros(0x110000, bool)  # code points that a piece of several characters holds
        for piece in self.raw:
            if len(piece) > 1 and len(text := piece.decode()) > 1:
                self.joins[[ord(c) for c in text]] = True
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        spans = Spans(self.flat)
        longest = max(by_length, default=0)
        self.tables = []
        for length in range(1, longest + 1):
            ids = np.array(by_length.get(length, ()), np.int64)
            longer = np.flatnonzero(self.size > length)
            code, start = (self._codes if length <= 2 else spans.hash), self.at[longer]
            h, begins = code(self.at[ids], self.at[ids] + length), code(start, start + length)
            # most spans are no piece, and most begin none: their codes, or their hashes' first bits, tell that at once
            flags = np.zeros(1 << 18, np.uint8)
            shift = _U(0 if length <= 2 else 46)
            flags[h >> shift] |= _U8_PIECE
            flags[begins >> shift] |= _U8_BEGINS
            order = np.argsort(h)
            self.tables.append((length, h[order], ids[order].astype(np.int32), flags, shift))

    def _codes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return codes(self.flat, starts, ends)


class Lattices:
    """Lattices of units, one after the other: nodes are byte positions, edges are pieces.

    `first` has each node's first edge; an edge has its piece, its length, the log probability that a path at its node
    takes it, and the running total of those probabilities. Edges of a node are in the order of their length; `skip` is
    the total before a node's last edge. `mass` has the log probability of all of a unit's paths.
    """

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray):
        units, n = len(starts) - 1, len(data)
        sizes = np.diff(starts)
        unit = np.repeat(np.arange(units), sizes)
        node = np.arange(n) + unit  # each unit has one node more than bytes
        end = np.repeat(starts[1:], sizes)
        self.root, self.end = starts[:-1] + np.arange(units), starts[1:] + np.arange(units)
        spans = Spans(data)
        lead = (data & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        char_start = np.flatnonzero(lead)
        char_size = np.diff(np.append(char_start, n))
        whole = np.zeros(len(char_start), bool)
        found = []
        room, left = np.arange(n), end - np.arange(n)
        for length, hashes, ids, flags, shift in vocabulary.tables:
            if length > 1:  # what no longer piece begins with, or has no room for one, is settled
                on = np.flatnonzero(((flag & _U8_BEGINS) > 0) & (left >= length))
                room, left = room[on], left[on]
            if not len(room):
                break
            h = codes(data, room, room + length) if length <= 2 else spans.hash(room, room + length)
            flag = flags[h >> shift]
            maybe = np.flatnonzero(flag & _U8_PIECE)
            at, h = room[maybe], h[maybe]
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[k] == h)
            at = at[hit]
            found.append((length, at, ids[k[hit]]))
            if length > 4:
                continue
            c = char[at]
            whole[c[lead[at] & (char_size[c] == length)]] = True
        spelled = np.flatnonzero(~whole[char]) if n else np.zeros(0, int)  # bytes of characters without a piece
        found.insert(0, (1, spelled, vocabulary.byte[data[spelled]]))
        counts = np.zeros(n + units + 1, np.int64)
        for _, at, _ in found:
            counts[node[at] + 1] += 1
        self.first = np.cumsum(counts)
        total = int(self.first[-1])
        self.piece, self.length = np.zeros(total, np.int32), np.zeros(total, np.int32)
        filled = self.first[:-1].copy()
        for length, at, ids in found:
            e = filled[node[at]]
            self.piece[e], self.length[e] = ids, length
            filled[node[at]] += 1
        degree = np.diff(self.first)
        target = np.repeat(np.arange(n + units), degree) + self.length
        mass = np.zeros(n + units)
        mass[self.end] = 1.0
        # nodes with edges in the order of their distance from their unit's end, and their edges, one node after the other
        inner = np.flatnonzero((sizes <= vocabulary.short)[unit])
        inner = inner[degree[node[inner]] > 0]
        far = (end[inner] - inner).astype(np.uint16)
        by_far = np.argsort(far, kind="stable")
        nodes = node[inner[by_far]]
        width = degree[nodes]
        edges = np.repeat(self.first[nodes], width) + ragged(width)
        begins = np.concatenate([[0], np.cumsum(width)])
        share, onto = vocabulary.p[self.piece[edges]], target[edges]
        cuts = np.searchsorted(far[by_far], np.arange(1, int(far.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a < b:
                x, y = int(begins[a]), int(begins[b])
                share[x:y] *= mass[onto[x:y]]
                mass[nodes[a:b]] = np.add.reduceat(share[x:y], begins[a:b] - x)
        with np.errstate(divide="ignore", invalid="ignore"):
            share /= np.repeat(mass[nodes], width)
            self.mass = np.log(mass[self.root])
            self.upto, self.log_p = np.zeros(total), np.full(total, NEVER)
            share[np.isnan(share)] = 0.0
            self.upto[edges], self.log_p[edges] = share, np.log(share)
        for u in np.flatnonzero(sizes > vocabulary.short).tolist():
            self._long(u, vocabulary.log_p)
        slot, live = 1, np.flatnonzero(degree > 1)
        while len(live):
            e = self.first[live] + slot
            self.upto[e] += self.upto[e - 1]
            slot += 1
            live = live[degree[live] > slot]
        self.upto[self.first[1:][degree > 0] - 1] = 2.0
        last = np.zeros(n + units, bool)
        last[self.end] = True
        self.jump = np.where(last[target], 0, self.length)  # 0: the path ends
        self.skip = np.zeros(n + units)
        several = np.flatnonzero(degree > 1)
        self.skip[several] = self.upto[self.first[several + 1] - 2]

    def _long(self, unit: int, log_p: np.ndarray) -> None:
        """The masses of one unit's nodes, from its end, by their logarithms; then its edges' probabilities."""
        root, end = int(self.root[unit]), int(self.end[unit])
        first = self.first[root : end + 1].tolist()
        a = first[0]
        ids = self.piece[a : first[-1]]
        p, size = log_p[ids].tolist(), self.length[a : first[-1]].tolist()
        mass = [NEVER] * (end - root) + [0.0]
        for at in range(end - root - 1, -1, -1):
            values = [p[e] + mass[at + size[e]] for e in range(first[at] - a, first[at + 1] - a)]
            top = max(values, default=NEVER)
            if top > NEVER:
                mass[at] = top + math.log(sum(math.exp(v - top) for v in values))
        self.mass[unit] = mass[0]
        mass = np.array(mass)
        at = np.repeat(np.arange(end - root), np.diff(first))
        with np.errstate(invalid="ignore"):
            own = log_p[ids] + mass[at + self.length[a : first[-1]]] - mass[at]
        own[np.isnan(own)] = NEVER
        self.log_p[a : first[-1]], self.upto[a : first[-1]] = own, np.exp(own)

    def walk(self, units: np.ndarray, seed: np.ndarray, what: int, where: np.ndarray):
        """A random path through each unit: pieces one path after the other, how many each has, and the log probabilities."""
        node, live, out, step = self.root[units], None, [], 0
        log_p, taken = np.zeros(len(units)), np.ones(len(units), np.int64)
        base = (np.asarray(seed, np.uint64) ^ mix(where.astype(np.uint64) + _U(what << 40))) if len(units) else np.zeros(0, np.uint64)
        while len(node):
            e = self.first[node + 1] - 1  # the longest piece, which is mostly taken; what falls below it looks at the others in turn
            u = uniform(base, step)
            below = np.flatnonzero(u < self.skip[node])
            if len(below):
                f, v = self.first[node[below]], u[below]
                on = np.flatnonzero(v >= self.upto[f])
                while len(on):
                    f[on] += 1
                    on = on[v[on] >= self.upto[f[on]]]
                e[below] = f
            out.append((live, self.piece[e]))
            if live is None:
                log_p = self.log_p[e]
            else:
                log_p[live] += self.log_p[e]
                taken[live] += 1
            jump = self.jump[e]
            going = np.flatnonzero(jump)
            live = going if live is None else live[going]
            node, base = node[going] + jump[going], base[going]
            step += 1
        at = np.cumsum(taken) - taken
        pieces = np.zeros(int(taken.sum()), np.int32)
        for k, (who, ids) in enumerate(out):
            pieces[(at if who is None else at[who]) + k] = ids
        return pieces, taken, log_p

    def draw_other(self, unit: int, without: list[tuple], random) -> tuple[tuple, float, float] | None:
        """A random path that is none of `without` (distinct paths), its log probability, and the probability of all of these; None if there is none.

        At each node the probability of the paths left out that lead on from it is taken off their edges; an edge that
        leads to nothing else is closed, which the number of paths from a node tells. Work grows with the unit's edges.
        """
        root, end = int(self.root[unit]), int(self.end[unit])
        first, n = self.first[root : end + 1].tolist(), end - root
        a, z = first[0], first[-1]
        piece, size, log_p = self.piece[a:z].tolist(), self.length[a:z].tolist(), self.log_p[a:z].tolist()
        first = [x - a for x in first]
        most = len(without) + 1
        ways = [0] * n + [1]  # how many paths lead on, up to `most`
        for at in range(n - 1, -1, -1):
            count = 0
            for e in range(first[at], first[at + 1]):
                if log_p[e] > NEVER:
                    count += ways[at + size[e]]
            ways[at] = count if count < most else most
        if ways[0] <= len(without):
            return None
        tails, taken = [], 0.0  # for each path left out, the probability of what follows each of its pieces
        for path in without:
            at, own = 0, []
            for x in path:
                e = piece.index(x, first[at], first[at + 1])
                own.append(log_p[e])
                at += size[e]
            total = 0.0
            for i in range(len(own) - 1, -1, -1):
                total += own[i]
                own[i] = math.exp(total)
            tails.append(own)
            taken += own[0]
        at, step, path, total = 0, 0, [], 0.0
        near = list(range(len(without)))  # paths left out that start like this one
        while at < n:
            options, every = [], 0.0
            for e in range(first[at], first[at + 1]):
                if log_p[e] == NEVER:
                    continue
                weight = math.exp(log_p[e])
                if near and (below := [i for i in near if without[i][step] == piece[e]]):
                    weight = 0.0 if ways[at + size[e]] <= len(below) else max(weight - sum([tails[i][step] for i in below]), 1e-300)
                if weight:
                    options.append((weight, e))
                    every += weight
            u = random() * every
            for weight, e in options:
                u -= weight
                if u < 0:
                    break
            path.append(piece[e])
            total += log_p[e]
            if near:
                near = [i for i in near if without[i][step] == piece[e]]
            at, step = at + size[e], step + 1
        return tuple(path), total, taken + math.exp(total)


class Known:
    """Lattices of the units seen lately, found by the hash of a unit."""

    def __init__(self, vocabulary: Vocabulary, most: int = KNOWN_UNITS):
        self.vocabulary, self.most = vocabulary, most
        self.hashes, self.which, self.blocks = np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def find(self, data: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number, in self.blocks, of each of the (distinct) units."""
        if len(self.hashes) + len(hashes) > self.most or self.blocks is not None and len(self.blocks.piece) > KNOWN_EDGES:
            self.hashes, self.which, self.blocks = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.hashes):
            new = self.hashes[np.minimum(at, len(self.hashes) - 1)] != hashes
        if new.any():
            sizes = np.diff(starts)[new]
            own = np.repeat(starts[:-1][new], sizes) + ragged(sizes)
            block = Lattices(self.vocabulary, data[own], np.concatenate([[0], np.cumsum(sizes)]))
            number = (len(self.blocks.root) if self.blocks else 0) + np.arange(int(new.sum()))
            self.blocks = joined(self.blocks, block) if self.blocks else block
            hashes_all, which = np.concatenate([self.hashes, hashes[new]]), np.concatenate([self.which, number])
            order = np.argsort(hashes_all, kind="stable")
            self.hashes, self.which = hashes_all[order], which[order]
        return self.which[np.searchsorted(self.hashes, hashes)]


def joined(a: Lattices, b: Lattices) -> Lattices:
    out = object.__new__(Lattices)
    nodes, edges = len(a.skip), len(a.piece)
    out.root, out.end = np.concatenate([a.root, b.root + nodes]), np.concatenate([a.end, b.end + nodes])
    out.first = np.concatenate([a.first[:-1], b.first + edges])
    for name in ("piece", "length", "jump", "mass", "skip", "log_p", "upto"):
        setattr(out, name, np.concatenate([getattr(a, name), getattr(b, name)]))
    return out


def units_of(data: np.ndarray, starts: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units start, and how many each text has: at line ends, after them, where spaces begin, and around characters that no piece joins to others (joins: by code point)."""
    first = np.zeros(len(data), bool)
    if len(data):
        line, space = data == 10, data == 32
        first[line] = True
        first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        first[starts[:-1][np.diff(starts) > 0]] = True
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            size = 2 + (data[lead] >= 0xE0).astype(int) + (data[lead] >= 0xF0)
            code = data[lead].astype(int) & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
            for k in range(1, 4):
                on = size > k
                code[on] = code[on] << 6 | data[np.minimum(lead[on] + k, len(data) - 1)] & 0x3F
            alone = ~joins[np.minimum(code, len(joins) - 1)]
            first[lead[alone]] = True
            after = lead[alone] + size[alone]
            first[after[after < len(data)]] = True
    begin = np.flatnonzero(first)
    return begin, np.diff(np.searchsorted(begin, starts))


class Sample:
    """A segmentation: its pieces, the log probability of each unit's part, and how many pieces lie before each unit's end."""

    __slots__ = ("value", "log_p", "log_ps", "ends", "pieces")

    def __init__(self, value, log_p, log_ps, ends, pieces):
        self.value, self.log_p, self.log_ps, self.ends, self.pieces = value, log_p, log_ps, ends, pieces


class Sampler:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known = Known(self.vocabulary)

    def sample(self, keys: list[bytes], data: np.ndarray, starts: np.ndarray, k: int):
        """For each text its samples by falling value, and kappa."""
        texts = len(starts) - 1
        filled = np.diff(starts) > 0
        data = np.insert(data, starts[:-1][filled], 32)  # the space that the model puts before a text
        starts = starts + np.concatenate([[0], np.cumsum(filled)])
        begin, counts = units_of(data, starts, self.vocabulary.joins)
        ends = np.append(begin[1:], len(data))
        hashes = Spans(data).hash(begin, ends)
        distinct, where, number = np.unique(hashes, return_index=True, return_inverse=True)
        sizes = (ends - begin)[where]
        own = np.repeat(begin[where], sizes) + ragged(sizes)
        unit = self.known.find(data[own], np.concatenate([[0], np.cumsum(sizes)]), distinct)[number] if len(begin) else np.zeros(0, np.int64)
        lattices = self.known.blocks
        seeds = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in keys], np.uint64)
        limit = np.concatenate([[0], np.cumsum(counts)])
        log_z = np.add.reduceat(np.append(lattices.mass[unit], 0.0), limit[:-1]) * (counts > 0) if len(unit) else np.zeros(texts)
        values = log_z - np.log(-np.log(uniform(seeds, 1)))
        samples: list[list[Sample]] = [[] for _ in range(texts)]
        heaps: list[list] = [[] for _ in range(texts)]
        todo = [(t, 0, float(values[t]), None) for t in range(texts)]  # text, first unit to draw, value, what comes before
        for turn in range(k):
            if not todo:
                break
            which, since = np.array([t for t, *_ in todo]), np.array([at for _, at, *_ in todo])
            sizes = counts[which] - since
            offs = np.concatenate([[0], np.cumsum(sizes)])
            inside = np.repeat(since, sizes) + ragged(sizes)
            pick = np.repeat(limit[which], sizes) + inside
            pieces, taken, log_ps = lattices.walk(unit[pick], np.repeat(seeds[which], sizes), turn, inside) if len(pick) else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
            piece_at = np.concatenate([[0], np.cumsum(taken)])
            running = np.concatenate([[0.0], np.cumsum(log_ps)])
            total = np.add.reduceat(np.append(log_ps, 0.0), offs[:-1]) * (sizes > 0)
            prefix = np.array([log_z[t] + (float(x[0].log_ps[: at - 1].sum()) + x[2] if x else 0.0) for t, at, _, x in todo])
            leaving = best_leaving(prefix, log_ps, running, offs, inside, uniform_seed(seeds[which], 2, turn), k + 1)
            bounds = np.array([x[2] for x in todo])
            for j, (t, at, value, before) in enumerate(todo):
                a, b = offs[j], offs[j + 1]
                p, ends, ids = log_ps[a:b], piece_at[a + 1 : b + 1] - piece_at[a], pieces[piece_at[a] : piece_at[b]]
                log_p = float(total[j])
                if before is not None:
                    base, new_ids, new_p = before
                    keep = int(base.ends[at - 2]) if at > 1 else 0
                    p = np.concatenate([base.log_ps[: at - 1], [new_p], p])
                    ends = np.concatenate([base.ends[: at - 1], [keep + len(new_ids)], ends + (keep + len(new_ids))])
                    ids = np.concatenate([base.pieces[:keep], np.array(new_ids, np.int32), ids])
                    log_p += prefix[j] - log_z[t]
                samples[t].append(Sample(value, float(log_p), p, ends, ids))
            row, at, g = leaving
            g = -np.logaddexp(-bounds[row], -g)  # truncated at the value of what they leave
            for j, i, x in zip(row.tolist(), at.tolist(), g.tolist()):
                t = todo[j][0]
                heapq.heappush(heaps[t], (-x, len(samples[t]), todo[j][1] + i, samples[t][-1], ()))
            todo = [x for t, *_ in todo if turn + 1 < k and (x := self._branch(t, heaps[t], unit, limit[t], lattices, int(seeds[t]), turn, log_z[t]))]
        return data, samples, [-h[0][0] if h else NEVER for h in heaps], log_z

    @staticmethod
    def _branch(t, heap, unit, start, lattices, seed, turn, log_z):
        """The text's next segmentation up to the unit where it leaves an earlier one."""
        while heap:
            value, _, at, base, without = heapq.heappop(heap)
            value = -value
            if not without:
                without = (tuple(base.pieces[(int(base.ends[at - 1]) if at else 0) : int(base.ends[at])].tolist()),)
            calls = iter(range(1 << 30))
            which = int(unit[start + at])
            got = lattices.draw_other(which, list(without), lambda: uniform_one(seed, 3, turn, at, next(calls)))
            if got is None:
                continue
            ids, log_p, taken = got
            more = (*without, ids)
            rest = 1.0 - taken
            if rest > 1e-12:
                mass = log_z + float(base.log_ps[:at].sum()) + math.log(rest)
                g = -float(np.logaddexp(-value, math.log(-math.log(uniform_one(seed, 4, turn, at))) - mass))
                heapq.heappush(heap, (-g, -turn, at, base, more))
            return t, at + 1, value, (base, ids, log_p)
        return None


def log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x)))."""
    if x > 6:
        return 0.0
    return math.log(-math.expm1(-math.exp(x))) if x > -30 else x


_loaded: dict = {}


def sampler(path: str, temperature: float) -> "Sampler":
    """A sampler that knows no lattices yet. A task has its own, so a Python worker keeps no more than the vocabulary from task to task."""
    if (path, temperature) not in _loaded:
        _loaded[path, temperature] = Vocabulary(path, temperature)
    return Sampler(_loaded[path, temperature])


def spelled(vocabulary: Vocabulary, pieces: np.ndarray) -> np.ndarray:
    """The bytes of pieces, one after the other."""
    sizes = vocabulary.size[pieces]
    return vocabulary.flat[np.repeat(vocabulary.at[pieces], sizes) + ragged(sizes)]


def round_trips(vocabulary: Vocabulary, samples: list[Sample], data: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether each sample's pieces, one after the other, are the bytes of its row of data."""
    same = np.zeros(len(samples), bool)
    per = max(1, len(samples) // 8)  # as many at a time as hold about half a step's bytes
    for a in range(0, len(samples), per):
        some, own = samples[a : a + per], row[a : a + per]
        flat = np.concatenate([x.pieces for x in some])
        ends = np.cumsum([len(x.pieces) for x in some])
        sizes = np.diff(np.concatenate([[0], np.cumsum(vocabulary.size[flat])])[ends], prepend=0)
        fits = sizes == starts[own + 1] - starts[own]
        got = spelled(vocabulary, flat)
        if not fits.all():
            got = got[np.repeat(fits, sizes)]
        own, sizes = own[fits], sizes[fits]
        wrong = got != data[np.repeat(starts[own], sizes) + ragged(sizes)]
        good = np.ones(len(own), bool)
        good[np.searchsorted(np.cumsum(sizes), np.flatnonzero(wrong), "right")] = False
        same[np.arange(a, a + len(some))[fits]] = good
    return same


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, model: str = MODEL, temperature: float = TEMPERATURE, digest: bool = False, nested: bool = False) -> DataFrame:
    """key, rank (0 first), log_prob, perturbed, log_inclusion and pieces of each of the text's samples.

    digest: instead of pieces, n_pieces, pieces_sha256 (of the ids as 4 bytes each, lowest first) and round_trip
    (whether decoding gives the text). nested: one row for each text, with its samples in an array and round_trip (of all).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("rank", T.IntegerType()), T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()), T.StructField("log_inclusion", T.DoubleType())]
    if digest:
        fields += [T.StructField("n_pieces", T.LongType()), T.StructField("pieces_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    else:
        fields += [T.StructField("pieces", T.ArrayType(T.IntegerType()))]
    if nested:
        fields = [T.StructField("samples", T.ArrayType(T.StructType(fields[1:]))), T.StructField("round_trip", T.BooleanType())]
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        s = sampler(model, temperature)
        for batch, data, starts in steps(batches):
            keys = batch.column("key")
            spaced, samples, kappas, log_z = s.sample([repr(x).encode() for x in keys.to_pylist()], data, starts, k)
            at = starts + np.concatenate([[0], np.cumsum(np.diff(starts) > 0)])
            row = np.repeat(np.arange(len(samples)), [len(x) for x in samples])
            flat = [one for own in samples for one in own]
            n = [len(one.pieces) for one in flat]
            rank = ragged(np.array([len(x) for x in samples]))
            score = [0.0 if kappas[t] == NEVER else log_inclusion(one.log_p + log_z[t] - kappas[t]) for t, one in zip(row.tolist(), flat)]
            columns = [keys if nested else keys.take(pa.array(row)), pa.array(rank.astype(np.int32)), pa.array([one.log_p for one in flat], pa.float64()), pa.array([one.value - log_z[t] for t, one in zip(row.tolist(), flat)], pa.float64()), pa.array(score, pa.float64())]
            if digest or nested:
                same = round_trips(s.vocabulary, flat, spaced, at, row)
            if digest:
                columns += [pa.array(n, pa.int64()), pa.array([hashlib.sha256(one.pieces.astype("<i4").tobytes()).hexdigest() for one in flat], pa.string()), pa.array(same, pa.bool_())]
            else:
                pieces = np.concatenate([one.pieces for one in flat]) if flat else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(pieces)))
            if nested:
                own = np.concatenate([[0], np.cumsum([len(x) for x in samples])]).astype(np.int32)
                every = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns[2:], arrow.field("samples").type.value_type)], fields=list(arrow.field("samples").type.value_type))
                wrong = np.zeros(len(samples), np.int64)
                np.add.at(wrong, row, ~same)
                columns = [keys, pa.ListArray.from_arrays(pa.array(own), every), pa.array(wrong == 0)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """encoded with the column text (replaced if there is one); null pieces give an empty text."""
    names, kept = encoded.columns, [c for c in encoded.columns if c != "text"]
    schema = T.StructType([encoded.schema[c] for c in kept] + [T.StructField("text", T.StringType())])

    def run(batches):
        vocabulary = sampler(model, TEMPERATURE).vocabulary
        for batch in batches:
            texts = [spelled(vocabulary, np.array(ids or (), np.int64)).tobytes()[1:].decode("utf-8", "replace") for ids in batch.column(names.index(pieces)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in kept] + [pa.array(texts, pa.string())], kept + ["text"])

    return encoded.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For training, a row for each text: doc_id, log_prob, log_inclusion and pieces of the first sampled segmentation, others (the further samples, as structs), and round_trip (whether all of them decode to the text)."""
    found = encode(docs, nested=True)
    first = F.get("samples", F.lit(0))
    return found.select("doc_id", first["log_prob"].alias("log_prob"), first["log_inclusion"].alias("log_inclusion"), first["pieces"].alias("pieces"), F.slice("samples", 2, SAMPLES).alias("others"), "round_trip")
