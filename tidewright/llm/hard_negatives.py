"""Hard negatives by Four-Russians scoring.

Components are whole numbers. A candidate is packed once into bit planes: for each bit of its components (two's complement)
a byte for each eight dimensions. An anchor has a table of 256 subset sums for each eight dimensions. A candidate's score
is then, from the highest plane down, twice what it was plus the looked-up sums of the plane's bytes (the sign's plane
counts negative): exact inner products without a multiplication by a component.

Anchors and candidates are dealt into blocks by hash, and every anchor block meets every candidate block in a task's
stream: anchors of the block first, of which there are ANCHORS on average, then candidates, batch by batch. Tasks keep the
first `top` of each anchor (and positive), so what is merged afterwards is small. Positives are looked for within one
label only, negatives in a second pass with the positives' scores at hand. Nothing is broadcast or collected but the
number of rows and the largest component.

Defined cases: rows with a null id, label or vector or with a null, NaN or infinite component take no part; a vector that
is shorter than the longest is filled up with zeros; rows that repeat an id, label and vector count once, and a row is no
positive of an anchor with its own id; of equal scores the smaller id comes first; an anchor without a positive, and a positive
without a negative in its range, have no rows; an empty table gives no rows; other columns are ignored. Components whose
products might not fit a long are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffles, table

TOP, LOW, HIGH = 5, 80, 100
#: Anchors and candidates of a block on average; anchors and candidates that are scored at once.
ANCHORS, CANDIDATES, TABLES, BATCH = 1 << 15, 1 << 12, 64, 2_048
_LOWEST = np.iinfo(np.int64).min


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """anchors (n x 8 g) to tables (g, 256, n): the sum of those of eight components whose bits an index has, the first component's bit the highest."""
    n, dims = anchors.shape
    groups = anchors.reshape(n, dims // 8, 8).transpose(1, 2, 0)
    sums = np.zeros((dims // 8, 1, n), anchors.dtype)
    for i in range(8):  # each component doubles the table
        sums = np.stack([sums, sums + groups[:, i, None, :]], axis=2).reshape(dims // 8, -1, n)
    return sums


def planes(values: np.ndarray, bits: int) -> np.ndarray:
    """values (n x 8 g, whole numbers of `bits` bits) to bytes (n, bits, g), the sign's plane first."""
    shifts = np.arange(bits - 1, -1, -1)
    return np.packbits(((values[:, None, :] >> shifts[None, :, None]) & 1).astype(np.uint8), axis=2)


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products (candidates x anchors) from tables of subset_sums() and bytes of planes()."""
    n, bits, groups = packed.shape
    total = None
    for b in range(bits):
        plane = tables[0][packed[:, b, 0]]
        for g in range(1, groups):
            plane += tables[g][packed[:, b, g]]
        if total is None:
            total = -plane
        else:
            total += total
            total += plane
    return total


def first_rows(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first n of their group: by score, highest first, then by id; one of those that repeat both."""
    order = np.lexsort((ids, -score, group))
    g, s, i = group[order], score[order], ids[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    order, g = order[new], g[new]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return order[rank < n]


def components(rows: DataFrame, vector: str, scale: float) -> Column:
    """floor(scale * x), x as double, of each component; null where one is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _streamed(batches, kind: str, dims: int, bits: int, wide: bool):
    """The first TOP of each anchor (kind: positive), or of each anchor's positive (negative), in each pair of blocks.

    Rows come by pair, anchors (a true) before candidates. Anchors have their components as data, candidates their planes.
    """
    number = np.int64 if wide else np.int32
    schema = pa.schema([("anchor", pa.int64()), ("twin", pa.int32()), ("positive", pa.int64()), ("bound", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
    pair, anchors, kept, waiting = None, [], None, []

    def settle():
        """Score what waits against the anchors of the pair."""
        nonlocal kept
        ids = np.concatenate([w[0] for w in waiting])
        labels = np.concatenate([w[1] for w in waiting])
        packed = np.concatenate([w[2] for w in waiting])
        waiting.clear()
        found = [kept] if kept is not None else []
        for at in range(0, len(own_ids), TABLES):
            to = min(at + TABLES, len(own_ids))
            made = scores(subset_sums(own[at:to]), packed)
            same = labels[:, None] == own_labels[None, at:to]
            if kind == "positive":
                ok = same & (ids[:, None] != own_ids[None, at:to]) & (made >= worst[None, at:to])
                if len(ids) > TOP:  # nothing below the block's own first ones
                    masked = np.where(ok, made.astype(np.int64), _LOWEST)
                    ok &= made >= np.partition(masked, len(ids) - TOP, axis=0)[len(ids) - TOP]
                c, a = np.nonzero(ok)
                found.append(np.stack([a + at, np.zeros_like(a), made[c, a].astype(np.int64), ids[c]]))
            else:
                reach = bounds[at:to]
                most = np.where(reach == _LOWEST, _LOWEST, reach).max(axis=1)
                c, a = np.nonzero(~same & (made <= most[None]) & (HIGH * made.astype(np.int64) >= least[None, at:to]))
                s = made[c, a].astype(np.int64)
                for k in range(reach.shape[1]):
                    p = reach[a, k]
                    ok = (p != _LOWEST) & (LOW * np.where(p == _LOWEST, 0, p) <= HIGH * s) & (s <= p)
                    found.append(np.stack([a[ok] + at, np.full(int(ok.sum()), k), s[ok], ids[c[ok]]]))
        every = np.concatenate(found, axis=1)
        kept = every[:, first_rows(every[0] * 64 + every[1], every[2], every[3], TOP)]
        if kind == "positive":
            group, n = np.unique(kept[0], return_counts=True)
            full = group[n == TOP]
            low = np.full(len(own_ids), np.iinfo(np.int64).max)
            np.minimum.at(low, kept[0], kept[2])
            worst[full] = low[full]

    def ended():
        if waiting:
            settle()
        if kept is None or not kept.shape[1]:
            return None
        a, k = kept[0], kept[1]
        named = positives[a, k] if kind == "negative" else np.zeros(len(a), np.int64)
        limit = bounds[a, k] if kind == "negative" else np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((own_ids[a], twins[a], named, limit, kept[3], kept[2]), schema.types)], schema=schema)

    for batch in batches:
        pairs, at = np.asarray(batch.column("pair")), 0
        flags = np.asarray(batch.column("a").to_numpy(zero_copy_only=False))
        edges = np.flatnonzero((pairs[1:] != pairs[:-1]) | (flags[1:] != flags[:-1])) + 1
        for to in [*edges.tolist(), len(pairs)]:
            part = batch.slice(at, to - at)
            if pairs[at] != pair:
                if pair is not None and not isinstance(anchors, list):
                    if (out := ended()) is not None:
                        yield out
                pair, anchors, kept = pairs[at], [], None
                waiting.clear()
            if flags[at]:
                anchors.append(part)
            elif len(anchors):
                if isinstance(anchors, list):
                    rows = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
                    anchors = rows
                    own_ids, own_labels, twins = (np.asarray(rows.column(n)) for n in ("id", "label", "twin"))
                    own = np.frombuffer(b"".join(rows.column("data").to_pylist()), np.int64).reshape(-1, dims).astype(number)
                    worst = np.full(len(own_ids), _LOWEST)
                    lists = [(p or [], i or []) for p, i in zip(rows.column("bounds").to_pylist(), rows.column("positives").to_pylist())]
                    width = max([1, *(len(p) for p, _ in lists)])
                    bounds = np.array([p + [_LOWEST] * (width - len(p)) for p, _ in lists], np.int64)
                    positives = np.array([i + [0] * (width - len(i)) for _, i in lists], np.int64)
                    least = np.where(bounds == _LOWEST, np.iinfo(np.int64).max // HIGH, bounds).min(axis=1) * LOW
                packed = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8).reshape(-1, bits, dims // 8)
                waiting.append((np.asarray(part.column("id")), np.asarray(part.column("label")), packed))
                if sum(len(w[0]) for w in waiting) >= BATCH:
                    settle()
            at = to
    if pair is not None and not isinstance(anchors, list) and (out := ended()) is not None:
        yield out


def mine(rows: DataFrame, vector: str = "embedding", every: int = 100, scale: float = 256.0, anchors_in: int = ANCHORS, candidates_in: int = CANDIDATES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. rows: vec_id, label and a vector of numbers; anchors: vec_id divisible by `every`."""
    known = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), components(rows, vector, scale).alias("v")).where("v IS NOT NULL")
    n, n_anchors, dims, low, high = known.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not n_anchors:
        return rows.sparkSession.createDataFrame([], result)
    dims, low, high = max(8, -(-(dims or 0) // 8) * 8), min(low or 0, 0), max(high or 0, 0)
    bits = max((high + 1).bit_length(), (-low).bit_length()) + 1
    largest = dims * max(-low, high, 1) << bits
    if HIGH * largest >= 1 << 62:
        raise ValueError(f"components up to {max(-low, high)} make scores beyond a long")
    wide = largest >= 1 << 31
    rounds, parts = math.ceil(n_anchors / anchors_in), max(math.ceil(n / candidates_in), math.ceil(shuffles(rows) / math.ceil(n_anchors / anchors_in)))

    def packed(batches):
        for batch in batches:
            column = batch.column("v").combine_chunks() if isinstance(batch.column("v"), pa.ChunkedArray) else batch.column("v")
            sizes = np.diff(np.asarray(column.offsets))
            values = np.zeros((batch.num_rows, dims), np.int64)
            values[np.repeat(np.arange(batch.num_rows), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten())
            data = [v.tobytes() for v in planes(values, bits)]
            whole = [v.tobytes() if i % every == 0 else None for v, i in zip(values, batch.column("id").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(data, pa.binary()), pa.array(whole, pa.binary())], ["id", "label", "data", "whole"])

    ready = cut(known.mapInArrow(packed, "id long, label long, data binary, whole binary"))
    twin = (F.row_number().over(Window.partitionBy("id").orderBy("label", "whole")) - 1).alias("twin")
    anchors = cut(ready.where("whole IS NOT NULL").select("id", "label", "whole").distinct().select("id", "label", F.col("whole").alias("data"), twin))

    def met(anchors: DataFrame, kind: str) -> DataFrame:
        own = F.lit(0) if kind == "negative" else F.col("label")  # positives are looked for within a label
        block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
        every_of = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        columns = ["pair", "a", "id", "label", "twin", "data", "bounds", "positives"]

        def dealt(df, i, j, a):
            return df.withColumns({"i": i, "j": j, "a": F.lit(a)}).withColumn("pair", F.xxhash64(own, "i", "j")).select(*columns)

        none = F.lit(None).cast("array<long>")
        left = dealt(anchors, block(rounds), every_of(parts), True)
        right = dealt(ready.select("id", "label", F.lit(0).alias("twin"), "data", none.alias("bounds"), none.alias("positives")), every_of(rounds), block(parts), False)
        both = left.unionByName(right).repartition(max(shuffles(rows), min(rounds * parts, 20 * shuffles(rows))), "pair").sortWithinPartitions("pair", F.desc("a"))
        return both.mapInArrow(lambda b: _streamed(b, kind, dims, bits, wide), "anchor long, twin int, positive long, bound long, id long, score long")

    none = F.lit(None).cast("array<long>")
    near = met(anchors.withColumns({"bounds": none, "positives": none}), "positive").distinct()
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "twin").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= TOP)
    lists = ranked.groupBy(F.col("anchor").alias("id"), "twin").agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.col("id").alias("p")))).alias("x"))
    lists = lists.select("id", "twin", F.col("x.score").alias("bounds"), F.col("x.p").alias("positives"))
    far = met(cut(anchors.join(lists, ["id", "twin"])), "negative").distinct()
    last = Window.partitionBy("anchor", "twin", "positive", "bound").orderBy(F.desc("score"), "id")
    out = far.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= TOP)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("bound").alias("positive_score"), F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mine(rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding"))


ORACLE = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
k AS (SELECT id, label, list_transform(v, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT id, label, unnest(q) AS x, unnest(range(len(q))) AS d FROM k),
s AS (SELECT a.id AS anchor, a.label AS al, b.id AS id, b.label AS bl, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM c a JOIN c b ON a.d = b.d WHERE a.id % 100 = 0 GROUP BY a.id, a.label, b.id, b.label),
p AS (SELECT anchor, id AS positive, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS r FROM s WHERE al = bl AND id <> anchor) WHERE r <= 5),
n AS (SELECT p.anchor, positive, p.score AS ps, s.id, s.score AS ns, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.id) AS r
      FROM p JOIN s ON s.anchor = p.anchor WHERE al <> bl AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(r AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 5
"""
