"""Exact substring dedup: longest previous factors of LENGTH bytes or more, over the whole corpus.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a smaller doc_id, or in the same document
at an earlier byte. That is where the longest previous factor of the string's start, the longest match with an earlier
start, is at least LENGTH.

No corpus fits one suffix array, so starts are first sorted into groups that any two equal strings share. Each string of
LENGTH bytes has an anchor, its GRAM-byte piece of least hash (the first of equals), which equal strings have at the same
place. Neighbouring starts mostly share an anchor; such a run of starts is one row, with the anchor's hash and a hash of
all bytes that the run's strings cover. Rows of equal bytes are settled at once: all but the first go. What is left are
runs that share an anchor with other bytes around it. The bytes of those are brought together by anchor, and of each
group the array of longest previous factors is computed, to a depth of LENGTH bytes: suffix order, common prefixes of
neighbours, and for each suffix the previous and the next one in that order whose position is smaller; the longer common
prefix with either is its factor. A string whose factor has LENGTH bytes goes. Bytes are compared there; runs settled at
once agree in 96 bits of hashes.

Rows that repeat are dropped in the task that finds them, before anything is shuffled. An anchor that more than HOT
different runs share is no group: its strings are grouped by anchor and by a hash of themselves, so strings that differ go
to different tasks, and equal ones in one task make one row. No group needs more memory than HOT runs.

Defined cases: null and empty texts, and texts under LENGTH bytes, lose nothing; a null doc_id comes after all others;
rows that repeat doc_id and text are one document, with one result for each row; matches never cross documents; a text of
any length is taken whole, in a step of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_dedup import text_tag
from .common import Spans, mix, ordered_id, ragged, shuffles, signed, steps, table

LENGTH, GRAM = 100, 24
FLUSH_ROWS, SUFFIXES, HOT = 1_000_000, 1 << 16, 4_096
_U = np.uint64


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` numbers in a row, by doubling."""
    n, at = len(x), 1
    while at * 2 <= width:
        x = np.minimum(x[:-at], x[at:])
        at *= 2
    return np.minimum(x[: n - width + 1], x[width - at :]) if at < width else x


def anchored_runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int):
    """Runs of starts that share an anchor: text, first start (from the text's start), where the anchor lies from it, starts after the first, anchor hash, hash of all bytes covered."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    spans = Spans(data)
    at = np.arange(n - gram + 1)
    hashes = spans.hash(at, at + gram)
    low = _U((1 << max(1, n.bit_length())) - 1)
    anchor = (sliding_least((hashes & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    begin = np.arange(len(anchor))
    size = np.diff(starts)
    inside = np.zeros(len(begin), bool)
    whole = np.flatnonzero(size >= length)
    if not len(whole):
        return none
    edge = np.zeros(n + 1, np.int32)
    edge[starts[whole]] += 1
    edge[starts[whole + 1] - length + 1] -= 1
    inside = np.cumsum(edge)[: len(begin)] > 0
    begin, anchor = begin[inside], anchor[inside]
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(begin)))
    begin, anchor = begin[first], anchor[first]
    left = anchor - begin
    text = np.searchsorted(starts, begin, "right") - 1
    cover = mix(spans.hash(begin, begin + count - 1 + length) + (left * 1024 + count).astype(np.uint64))
    return text, begin - starts[text], left, count - 1, hashes[anchor], cover


#: What scan() passes on, packed, as it is most of what is shuffled. A run: h (48 bits of the anchor's hash), u (48 bits of
#: the hash of all bytes covered, then place and more), o, t and p. What goes: u is the number of bytes.
PACKED = "gone boolean, h long, u long, o long, t long, p int"
ROW = "gone boolean, hot boolean, h long, o long, t long, p int, place int, more int"


def _batch(names: str, *columns) -> pa.RecordBatch:
    names = [x.split() for x in names.split(", ")]
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(columns, names)], [n for n, _ in names])


def first_rows(h, u, o, t, p, before=None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in the order of their columns: which are the first of their h and u, and which are later (neither is a row at the first one's place, from a repeated document). before: the first row of the last h and u so far."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (u[1:] != u[:-1])
    at = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    places = [c[at] for c in (o, t, p)]
    if before is not None and before[:2] == (h[0], u[0]):
        new[0] = False
        lead = at == 0
        for c, v in zip(places, before[2:]):
            c[lead] = v
    return new, ~new & ((o != places[0]) | (t != places[1]) | (p != places[2]))


def union_of(o: np.ndarray, t: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Overlapping ranges of the same o and t as one: o, t, a, b."""
    order = np.lexsort((a, t, o))
    o, t, a, b = o[order], t[order], a[order], b[order]
    other = np.ones(len(o), bool)
    other[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
    level = np.cumsum(other) << 32
    reach = np.maximum.accumulate(level + b)
    new = other.copy()
    new[1:] |= level[1:] + a[1:] > reach[:-1]
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(o)) - 1
    return o[at], t[at], a[at], reach[end] - level[end]


def scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all texts, and what goes because an equal run comes earlier among those that a task has seen at once."""
    if not 0 < length - gram < 256:
        raise ValueError("length must exceed gram, by less than 256")

    def run(batches):
        kept, size = [], 0

        def settle():
            rows = [np.concatenate(x) for x in zip(*kept)]
            order = np.lexsort(rows[::-1])
            h, u, o, t, p = (x[order] for x in rows)
            first, later = first_rows(h, u, o, t, p)
            yield _batch(PACKED, np.zeros(int(first.sum()), bool), h[first], u[first], o[first], t[first], p[first])
            if later.any():
                o, t, a, b = union_of(o[later], t[later], p[later], p[later] + (u[later] & 0xFF) + length)
                # dealt out by document
                yield _batch(PACKED, np.ones(len(o), bool), signed(mix(o.astype(np.uint64))), b - a, o, t, a)

        for batch, data, starts in steps(batches):
            text, p, left, more, h, u = anchored_runs(data, starts, length, gram)
            o, t = np.asarray(batch.column("o")), np.asarray(batch.column("t"))
            packed = (u >> _U(16) << _U(16)) | (left.astype(np.uint64) << _U(8)) | more.astype(np.uint64)
            kept.append(((mix(h) >> _U(16)).astype(np.int64), signed(packed), o[text], t[text], p))
            size += len(text)
            if size > FLUSH_ROWS:
                yield from settle()
                kept, size = [], 0
        if size:
            yield from settle()

    return docs.select("o", "t", "text").mapInArrow(run, PACKED)


def settle_equal(rows: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """What goes (`more` is then the bytes beyond LENGTH), and runs whose anchor other bytes share, hot where more than `hot` do. One pass over rows in order; the runs of one anchor, up to `hot`, are held back."""
    rows = rows.repartition(shuffles(rows), "h").sortWithinPartitions("gone", "h", "u", "o", "t", "p")

    def unpacked(gone: bool, is_hot, h, u, o, t, p) -> pa.RecordBatch:
        return _batch(ROW, np.full(len(h), gone), is_hot, h, o, t, p, (u >> 8) & 0xFF, u & 0xFF)

    def run(batches):
        before, held, over = None, None, None  # first row of the last h and u; the runs of the last h; an h known to be hot
        for batch in batches:
            gone = batch.column("gone").to_numpy(zero_copy_only=False)
            every = [batch.column(n).to_numpy() for n in ("h", "u", "o", "t", "p")]
            h, u, o, t, p = (x[gone] for x in every)
            yield _batch(ROW, gone[gone], np.zeros(len(h), bool), h, o, t, p, np.zeros(len(h), int), u - length)
            c = [x[~gone] for x in every]
            if not len(c[0]):
                continue
            new, later = first_rows(*c, before)
            if new.any():
                before = tuple(x[np.flatnonzero(new)[-1]] for x in c)
            yield unpacked(True, np.zeros(int(later.sum()), bool), *(x[later] for x in c))
            first = [x[new] for x in c]
            if not len(first[0]):
                continue
            if held is not None:
                first = [np.concatenate([a, b]) for a, b in zip(held, first)]
            h = first[0]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(at, len(h)))
            many = size > hot
            if over is not None:
                many |= h[at] == over
            size, is_hot = np.repeat(size, size), np.repeat(many, size)
            end = len(h) if many[-1] else int(at[-1])
            ready = (size > 1) | is_hot
            ready[end:] = False
            yield unpacked(False, is_hot[ready], *(x[ready] for x in first))
            over = h[-1] if many[-1] else None
            held = None if many[-1] else [x[end:] for x in first]
        if held is not None and len(held[0]) > 1:
            yield unpacked(False, np.zeros(len(held[0]), bool), *held)

    return rows.mapInArrow(run, ROW)


CONTEXT = "h long, o long, t long, p int, place int, more int, cover binary"


def contexts(needed: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """needed with the bytes that each run's strings cover; of hot runs, a row for each string, and without cover what equal strings of the same step settle.

    texts: all columns that the last join takes too, so that Spark shuffles the texts once.
    """
    names = [x.split()[0] for x in CONTEXT.split(", ")]

    def rows(h, o, t, p, place, more, cover):
        columns = [np.asarray(h, np.int64), np.asarray(o, np.int64), np.asarray(t, np.int64), *(np.asarray(x, np.int32) for x in (p, place, more))]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cover, pa.binary())], names)

    def run(batches):
        for batch, data, starts in steps(batches):
            runs = batch.column("runs")
            row = np.repeat(np.arange(len(starts) - 1), pa.compute.list_value_length(runs).to_numpy())
            h, p, place, more, hot = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            o, t = (batch.column(n).to_numpy()[row] for n in ("o", "t"))
            raw = data.tobytes()
            begin, cold = starts[:-1][row] + p, np.flatnonzero(~hot)
            yield rows(h[cold], o[cold], t[cold], p[cold], place[cold], more[cold], [raw[a : a + length + m] for a, m in zip(begin[cold].tolist(), more[cold].tolist())])
            if not hot.any():
                continue
            count = np.where(hot, more + 1, 0)
            one = np.repeat(np.arange(len(row)), count)
            at = begin[one] + ragged(count)
            own = mix(h[one].view(np.uint64) ^ Spans(data).hash(at, at + length))
            o, t, p = o[one], t[one], p[one] + ragged(count)
            order = np.lexsort((p, t, o, own))
            own, o, t, p, at = (x[order] for x in (own, o, t, p, at))
            first, later = first_rows(own, own, o, t, p)
            yield rows(signed(own[first]), o[first], t[first], p[first], np.zeros(first.sum()), np.zeros(first.sum()), [raw[a : a + length] for a in at[first].tolist()])
            if later.any():
                o, t, a, b = union_of(o[later], t[later], p[later], p[later] + length)
                yield rows(signed(mix(o.view(np.uint64) + a.astype(np.uint64))), o, t, a, np.zeros(len(a)), b - a - length, [None] * len(a))

    wanted = needed.where("not gone").groupBy("o", "t").agg(F.collect_list(F.struct("h", "p", "place", "more", "hot")).alias("runs"))
    return texts.join(wanted, ["o", "t"]).mapInArrow(run, CONTEXT)


def nearest_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For suffixes in their order: the common prefix with the nearest one before that has a smaller position; 0 without one. lcp: the common prefix with the neighbour before.

    Each suffix jumps from candidate to candidate's candidate, all at once; the few that jump on for long are finished one
    by one.
    """
    n = len(position)
    back, low = np.arange(-1, n - 1), lcp.copy()

    def going(i):
        return i[(back[i] >= 0) & (low[i] > 0) & (position[back[i]] >= position[i])]

    live = going(np.arange(n))
    while len(live) > 64:
        j = back[live]
        low[live], back[live] = np.minimum(low[live], low[j]), back[j]
        live = going(live)
    if len(live):
        where, least, jump = position.tolist(), low.tolist(), back.tolist()
        for i in live.tolist():
            j, m = jump[i], least[i]
            while j >= 0 and m > 0 and where[j] >= where[i]:
                j, m = jump[j], min(m, least[j])
            low[i], back[i] = m, j
            jump[i], least[i] = j, m
    low[back < 0] = 0
    return low


def longest_previous_factors(flat: np.ndarray, at: np.ndarray, position: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes, up to depth, the string at each of `at` has in common with the best one of smaller position. position: the strings' order in the corpus, equal for the same place."""
    n = len(at)
    windows = np.lib.stride_tricks.sliding_window_view(flat, depth)[at]
    order = np.argsort(windows.view(f"S{depth}").ravel(), kind="stable")
    lcp = np.zeros(n, np.int64)
    for i in range(1, n, 1 << 14):
        j = min(n, i + (1 << 14))
        other = windows[order[i:j]] != windows[order[i - 1 : j - 1]]
        lcp[i:j] = np.where(other.any(axis=1), other.argmax(axis=1), depth)
    position = position[order]
    # strings that agree in all bytes: the one of least position stands for them, and is the others' smaller neighbour
    begin = np.flatnonzero(lcp < depth)
    size = np.diff(np.append(begin, n))
    least, between = np.minimum.reduceat(position, begin), lcp[begin]
    before = nearest_smaller(least, between)
    after = nearest_smaller(least[::-1].copy(), np.append(0, between[1:][::-1]))[::-1]
    out = np.zeros(n, np.int64)
    out[order] = np.where(position > np.repeat(least, size), depth, np.repeat(np.maximum(before, after), size))
    return out


def compare_contexts(rows: DataFrame, length: int) -> DataFrame:
    """o, t, a and b: the bytes that go because of what the rows' anchors share. Rows of a group come together, by position; a task takes as many groups at once as SUFFIXES allows."""
    rows = rows.repartition(shuffles(rows), "h").sortWithinPartitions("h", "o", "t", "p")

    def of(group):
        h, o, t, p, place, more, cover = group
        flat, at = np.frombuffer(b"".join(cover), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in cover])[:-1]])
        _, rank = np.unique(np.array(list(zip(o, t)), dtype=[("o", np.int64), ("t", np.int64)]), return_inverse=True)
        count = np.array(more, np.int64) + 1
        row, k = np.repeat(np.arange(len(count)), count), ragged(count)
        offset = k - np.array(place)[row]  # of the string's start from its anchor; equal strings have equal ones
        p = np.array(p, np.int64)
        gone = np.zeros(len(row), bool)
        slices = [np.arange(len(row))] if len(row) <= 4 * SUFFIXES else [np.flatnonzero(offset == x) for x in np.unique(offset)]
        for s in slices:
            gone[s] = longest_previous_factors(flat, at[row[s]] + k[s], (rank[row[s]].astype(np.int64) << 32) + p[row[s]] + k[s], length) >= length
        s = np.flatnonzero(gone)
        if len(s):
            new = np.ones(len(s), bool)
            new[1:] = (row[s][1:] != row[s][:-1]) | (k[s][1:] != k[s][:-1] + 1)
            i = np.flatnonzero(new)
            j = np.append(i[1:], len(s)) - 1
            r, a, b = row[s[i]], p[row[s[i]]] + k[s[i]], p[row[s[j]]] + k[s[j]] + length
            yield found(np.array(o, np.int64)[r], np.array(t, np.int64)[r], a, b)

    def found(o, t, a, b):
        return pa.RecordBatch.from_arrays([pa.array(o), pa.array(t), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["o", "t", "a", "b"])

    def run(batches):
        names = ("h", "o", "t", "p", "place", "more", "cover")
        held: list[list] = [[] for _ in names]
        weight = 0
        for batch in batches:
            settled = batch.column("cover").is_null().to_numpy(zero_copy_only=False)
            if settled.any():
                o, t, p, more = (batch.column(n).to_numpy()[settled] for n in ("o", "t", "p", "more"))
                yield found(o, t, p, p + length + more)
                batch = batch.filter(pa.array(~settled))
            for values in zip(*(batch.column(n).to_pylist() for n in names)):
                other = bool(weight) and values[0] != held[0][-1]
                if weight > SUFFIXES and other:
                    yield from of(held)
                    held, weight = [[] for _ in names], 0
                elif weight > 8 * SUFFIXES:  # only equal strings make such a group: the first of them stands for all
                    yield from of(held)
                    lead = held[0].index(held[0][-1])
                    held = [[x[lead]] for x in held]
                    weight = held[5][0] + 1
                for x, v in zip(held, values):
                    x.append(v)
                weight += values[5] + 1
        if weight:
            yield from of(held)

    return rows.mapInArrow(run, "o long, t long, a int, b int")


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs (with o and t: see text_tag) and cuts: what goes, as maximal runs of bytes (start, end, start, end ...). For texts with nothing to remove cuts is null."""
    rows = settle_equal(scan(docs, length, gram), length, hot)
    equal = rows.where("gone").select("o", "t", F.col("p").alias("a"), (F.col("p") + F.col("more") + length).alias("b"))
    partly = compare_contexts(contexts(rows, docs, length), length)
    return docs.join(equal.unionByName(partly).groupBy("o", "t").agg(F.collect_list(F.struct("a", "b")).alias("cuts")), ["o", "t"], "left")


def merged(cuts: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((c["a"], c["b"]) for c in cuts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, kept (the bytes that stay) and spans (start and end of each run that goes, flattened) of each row of docs (doc_id, text)."""
    source = docs.select("doc_id", ordered_id().alias("o"), text_tag().alias("t"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, data, starts in steps(batches):
            raw, kept, spans = data.tobytes(), [], []
            for i, j, cuts in zip(starts[:-1].tolist(), starts[1:].tolist(), batch.column("cuts").to_pylist()):
                at, parts, own = i, [], merged(cuts)
                for a, b in own:
                    parts.append(raw[at : i + a])
                    at = i + b
                parts.append(raw[at:j])
                kept.append(b"".join(parts))
                spans.append([x for s in own for x in s])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.int64())), pa.array(np.diff(starts), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], ["doc_id", "kept", "spans", "n_bytes", "kept_sha256"])

    return removed(source, length, gram, hot).select("doc_id", "text", "cuts").mapInArrow(run, f"doc_id {kind}, kept binary, spans array<long>, n_bytes long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")
