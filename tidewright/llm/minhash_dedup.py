"""Near-duplicate detection by ProbMinHash.

Shingles are five lower-cased words in a row (a shorter text is one shingle), weighted by how often the text has them.
Similarity is probability Jaccard: J_P(a, b) = sum over d of 1 / (sum over d' of max(a[d'] / a[d], b[d'] / b[d])), for
the d that both have. It is plain Jaccard where no shingle repeats. Texts are near-duplicates from THRESHOLD on.

Signature: each shingle is a Poisson process whose arrivals have the shingle's weight as their rate and fall into random
slots; a slot keeps the shingle that arrives first. Shingles stop as soon as their next arrival is later than the latest
first arrival of all slots. Two texts agree in a slot with probability J_P.

Texts of the same words are one class from the start. Representatives that agree in all slots of a band share a bucket;
what buckets connect is a group, and its least member is the leader. Links are verified exactly, in two rounds. First each
member of a group is held against the leader, which settles a template's near copies with one comparison each. In a group
with members that are not near the leader, each of those is held against every other member, so no link is lost between
texts that any band has brought together: a group is split into blocks of at most BLOCK texts, and a task gets the shingles
of two blocks. Only that second round can grow with the square of something, namely of those members of a group that are
not near their leader. Classes are the connected components of verified links.

Defined cases: null and empty texts, and texts without words, are classes of their own; a null doc_id comes after all
others; rows that repeat doc_id and text are one document; the class id is the least doc_id of a class (null if it has
none); a text of any length is taken whole, in a step of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, LOWER, Spans, cut, mix, ordered_id, ragged, shielded, shuffles, signed, slices, steps, table, words
from .components import components

WORDS, BANDS, ROWS, THRESHOLD, BLOCK = 5, 32, 6, 0.8, 128
_U = np.uint64
_PLACE = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(WORDS)], np.uint64)


def shingles(data: np.ndarray, starts: np.ndarray, width: int = WORDS):
    """Distinct shingles as (text, hash, weight), ordered by text and hash, and two digests of each text's words."""
    data = LOWER[data]
    begin, end, counts = words(data, starts)
    h = Spans(data).hash(begin, end)
    texts = len(starts) - 1
    text, inside = np.repeat(np.arange(texts), counts), ragged(counts)
    first = np.cumsum(counts) - counts
    digests = []
    for k in (1, 2):
        at_place = np.concatenate([[0], np.cumsum(mix(h + (inside.astype(np.uint64) << _U(8)) * _U(0x9E3779B97F4A7C15) + _U(k)))]).astype(np.uint64)
        digests.append(at_place[first + counts] - at_place[first])
    total = h * _PLACE[0]
    for k in range(1, width):
        total[: len(h) - k] += h[k:] * _PLACE[k] if k < len(h) else _U(0)
    left = np.repeat(counts, counts) - inside
    whole = left >= width
    short = np.flatnonzero((counts > 0) & (counts < width))
    parts = [(text[whole], mix(total[whole]))]
    if len(short):
        own = np.repeat(first[short], counts[short]) + ragged(counts[short])
        sums = np.add.reduceat(h[own] * _PLACE[inside[own]], np.cumsum(counts[short]) - counts[short])
        parts.append((short, mix(sums + counts[short].astype(np.uint64))))
    text, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return text[at], value[at], np.diff(np.append(at, len(text))), digests


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, slots: int) -> np.ndarray:
    """The shingle that arrives first in each slot, a row for each text; rows of texts without shingles are 0."""
    first = np.full((texts, slots), np.inf)
    who = np.zeros((texts, slots), np.uint64)
    flat_first, flat_who = first.reshape(-1), who.reshape(-1)
    row, h, w = text, value, 1.0 / weight
    time = np.zeros(len(row))
    turn = 0
    while len(row):
        turn += 1
        r = mix(h + _U(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((r >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) * w
        slot = row * slots + (mix(r) >> _U(32)).astype(np.int64) * slots // (1 << 32)
        hit = np.flatnonzero(time < flat_first[slot])
        hit = hit[np.argsort(-time[hit])]  # of several in one slot the earliest is written last
        flat_first[slot[hit]] = time[hit]
        flat_who[slot[hit]] = h[hit]
        rows, where = np.unique(row, return_inverse=True) if turn > 4 else (np.arange(texts), row)
        going = np.flatnonzero(time < first[rows].max(axis=1)[where])
        row, h, w, time = row[going], h[going], w[going], time[going]
    return who


def band_hashes(who: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(who), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            out[:, b] = mix(out[:, b] * _U(0x9E3779B97F4A7C15) + who[:, b * rows + r] + _U(b + 1))
    return out


def signed_rows(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """o, t, d1, d2 and bands of each row of docs (o, t, text); no bands for texts without words."""

    def run(batches):
        for batch, data, starts in steps(batches):
            texts = len(starts) - 1
            text, value, weight, (d1, d2) = shingles(data, starts)
            hashes = signed(band_hashes(signatures(text, value, weight, texts, bands * rows), bands, rows))
            some = np.zeros(texts, bool)
            some[text] = True
            ends = np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("t"), pa.array(signed(d1)), pa.array(signed(d2)), listed], ["o", "t", "d1", "d2", "bands"])

    return docs.select("o", "t", "text").mapInArrow(run, "o long, t long, d1 long, d2 long, bands array<long>")


def probability_jaccard(a: tuple, b: tuple) -> float:
    """J_P of two texts, each as sorted hashes and their weights, in n log n steps."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    # with ratio[d'] = x/y (no bound if only a has d'), max(x'/x, y'/y) is x'/x where ratio' > ratio, else y'/y
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    after = np.searchsorted(ratio, ratio, "right")
    sx, sy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    return float(np.sum(1 / ((only_a + sx[-1] - sx[after]) / x + (only_b + sy[after]) / y)))


def is_near(a: tuple, b: tuple, inter: int, threshold: float) -> bool:
    if a[2] and b[2]:  # no shingle repeats
        return inter >= threshold * (len(a[0]) + len(b[0]) - inter) - 1e-9
    return probability_jaccard(a, b) >= threshold - 1e-12


def links_among(docs: list, cross: int | None, threshold: float, labels: list | None = None) -> list[tuple[int, int]]:
    """Links that connect what they can: pairs of numbers. docs: (hashes, weights, whether all weights are 1). cross: links go between those before it and the rest. labels: texts of one label are connected already."""
    n = len(docs)
    flat = np.concatenate([d[0] for d in docs])
    _, number = np.unique(flat, return_inverse=True)
    at = np.concatenate([[0], np.cumsum([len(d[0]) for d in docs])])
    kinds = int(number.max()) + 1
    a, b = (slice(0, n), slice(0, n)) if cross is None else (slice(0, cross), slice(cross, n))
    inter = np.zeros((a.stop, n - b.start), np.float32)
    width = max(1, (2 << 20) // n)
    owner = np.repeat(np.arange(n), np.diff(at))
    by = np.argsort(number, kind="stable")
    bounds = np.searchsorted(number[by], np.arange(0, kinds + width, width))
    for k in range(len(bounds) - 1):
        part = by[bounds[k] : bounds[k + 1]]
        m = np.zeros((n, min(width, kinds - k * width)), np.float32)
        m[owner[part], number[part] - k * width] = 1
        inter += m[a] @ m[b].T
    sizes = np.diff(at)
    plain = np.array([d[2] for d in docs])
    both = sizes[a][:, None] + sizes[b][None, :] - inter
    maybe = np.where(plain[a][:, None] & plain[b][None, :], inter >= threshold * both - 1e-6, inter > 0)
    i, j = np.nonzero(maybe)
    score = -inter[i, j] / (sizes[a][i] + sizes[b][j])
    shared = inter[i, j].astype(int)
    j = j + b.start
    keep = np.ones(len(i), bool) if cross is not None else i < j
    if labels is not None:
        known = np.unique(labels, return_inverse=True)[1]
        keep &= known[i] != known[j]
    i, j, score, shared = (x[keep] for x in (i, j, score, shared))
    order = np.argsort(score, kind="stable")
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    if labels is not None:
        lead: dict = {}
        for x, label in enumerate(labels):
            parent[x] = lead.setdefault(label, x)
    out = []
    for x, y, n_shared in zip(i[order].tolist(), j[order].tolist(), shared[order].tolist()):
        p, q = root(x), root(y)
        if p != q and is_near(docs[x], docs[y], n_shared, threshold):
            parent[p] = q
            out.append((x, y))
    return out


def verified(groups: DataFrame, docs: DataFrame, threshold: float, block: int) -> DataFrame:
    """a and b: links within groups between nodes of different labels, of which one at least is in front. groups: near, node, o, t, front, label; docs: o, t, text."""
    blocks = groups.groupBy("near").agg(*[F.ceil(F.count_if(c) / block).cast("int").alias(n) for n, c in (("fronts", F.col("front")), ("others", ~F.col("front")))])
    spread = F.xxhash64("node")
    own = F.when(F.col("front"), F.pmod(spread, F.col("fronts"))).otherwise(F.col("fronts") + F.pmod(spread, F.greatest("others", F.lit(1)))).cast("int")
    # written before the join, so that Spark can split the rows of a large group
    placed = groups.join(cut(blocks).hint("merge"), "near").withColumn("own", own)
    texts = docs.join(placed.hint("merge"), ["o", "t"]).dropDuplicates(["near", "node"])
    columns = ("near", "node", "label", "own", "front", "fronts", "others")

    def shingle(batches):
        for batch, data, starts in steps(batches):
            text, value, weight, _ = shingles(data, starts)
            cuts = np.searchsorted(text, np.arange(len(starts)))
            hashes = [value[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            weights = [b"" if (weight[a:b] == 1).all() else weight[a:b].astype("<i4").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())], [*columns, "hashes", "weights"])

    sets = texts.select(*columns, "text").mapInArrow(shingle, "near long, node long, label long, own int, front boolean, fronts int, others int, hashes binary, weights binary")
    last = F.when(F.col("front"), F.col("fronts") + F.col("others")).otherwise(F.col("fronts")) - 1
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select("near", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label", "hashes", "weights")
    pairs = pairs.repartition(shuffles(groups), "near", "i", "j").sortWithinPartitions("near", "i", "j", "own", "node")

    def check(batches):
        group, key = [], None

        def flush():
            if len(group) < 2:
                return
            own = [g[0] for g in group]
            cross = own.index(key[2]) if key[1] != key[2] and key[2] in own else None
            if key[1] != key[2] and (cross is None or cross == 0):
                return
            for x, y in links_among([g[2] for g in group], cross, threshold, [g[3] for g in group]):
                yield group[x][1], group[y][1]

        for batch in slices(batches):
            out = []
            for near, i, j, own, node, label, hashes, weights in zip(*(batch.column(c).to_pylist() for c in ("near", "i", "j", "own", "node", "label", "hashes", "weights"))):
                if (near, i, j) != key:
                    out.extend(flush())
                    group, key = [], (near, i, j)
                h = np.frombuffer(hashes, np.uint64)
                group.append((own, node, (h, np.frombuffer(weights, "<i4") if weights else np.ones(len(h), np.int8), not weights), label))
            yield _pairs(out)
        yield _pairs(list(flush()))

    return pairs.mapInArrow(check, "a long, b long")


def _pairs(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """o, t and class_o, class_t (the least member of its class) of each row of docs (o, t, text)."""
    sig = cut(signed_rows(docs, bands, rows))
    classes = sig.where(F.size("bands") > 0).groupBy("d1", "d2").agg(F.min(F.struct("o", "t")).alias("rep"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", F.col("d1")))
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    star = keys.join(cut(buckets).hint("merge"), "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # members, marked and second are written, as each is read several times: a plan that held what they come from would run it again
    members = cut(components(star).select("node", F.col("label").alias("near")).join(classes.select("node", "rep.o", "rep.t").hint("merge"), "node"))
    texts = docs.select("o", "t", "text")
    first = members.select("near", "node", "o", "t", (F.col("node") == F.col("near")).alias("front"), F.col("node").alias("label"))
    links = cut(verified(first, texts, threshold, block)).select(F.least("a", "b").alias("near"), F.greatest("a", "b").alias("node"))
    marked = cut(members.where("near <> node").join(links.withColumn("linked", F.lit(True)).hint("merge"), ["near", "node"], "left").withColumn("front", F.col("linked").isNull()))
    # the leader itself has been held against all; a group of it and one other member has nothing left to compare
    open_ = cut(marked.groupBy("near").agg(F.count("*").alias("n"), F.count_if("front").alias("fronts")).where("fronts > 0 and n > 1").select("near"))
    second = cut(marked.join(open_.hint("merge"), "near").select("near", "node", "o", "t", "front", F.when(F.col("front"), F.col("node")).otherwise(F.col("near")).alias("label")))
    more = verified(second, texts, threshold, block)
    linked = components(links.select(F.col("near").alias("a"), F.col("node").alias("b")).unionByName(more))
    reps = classes.select("node", "d1", "d2", "rep").join(linked.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = reps.groupBy("label").agg(F.min("rep").alias("least"))
    named = reps.join(least.hint("merge"), "label").select("d1", "d2", F.col("least.o").alias("class_o"), F.col("least.t").alias("class_t"))
    found = sig.where(F.size("bands") > 0).select("o", "t", "d1", "d2").join(named.hint("merge"), ["d1", "d2"]).select("o", "t", "class_o", "class_t")
    alone = sig.where(F.size("bands") == 0).select("o", "t", F.col("o").alias("class_o"), F.col("t").alias("class_t"))
    return found.unionByName(alone)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"o": ordered_id(), "t": F.xxhash64(F.coalesce("text", F.lit("")))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and kept (whether it is the one of its class that stays) of each document."""
    found = near_duplicates(keyed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    shown = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return found.select(shown("o").alias("doc_id"), shown("class_o").alias("class_id"), ((F.col("o") == F.col("class_o")) & (F.col("t") == F.col("class_t"))).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the least."""
    found = near_duplicates(keyed(docs).select("o", "t", "text"))
    gone = found.where("o <> class_o or t <> class_t").select(F.col("o").alias("_o"), F.col("t").alias("_t")).distinct()
    key = {"_o": ordered_id(), "_t": F.xxhash64(F.coalesce("text", F.lit("")))}
    return shielded(docs, ("doc_id", "text"), lambda rows: rows.withColumns(key).join(gone.hint("merge"), ["_o", "_t"], "left_anti").dropDuplicates(["_o", "_t"]))
