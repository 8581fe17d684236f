"""The trie of shared conversation beginnings, as a burst trie.

A turn is a unit of 20 bytes: the md5 of its role and text, and its number of words. A conversation is the path of its
units. Containers hold the paths beneath one trie node. A container of more than `limit` units bursts: what its paths all
share and the next turn id become trie heads, and its paths go to containers by that id, until no container is larger. So
whatever shares a beginning, no task holds more than a container. The containers that remain are sorted by path, and one
sweep over each emits its nodes as they close; sums of the heads follow from what lies beneath them, last burst first.

Equal conversations are one path with a weight, so a group of copies of any size never bursts anything. Their ids are
hashed in ascending order: ranges of ids make joined pieces, and only those pieces of a group meet.

While a container may be larger than 1 / MOST_HEADS of all units, fewer than MOST_HEADS burst at once, and their keys are
broadcast; afterwards no key is hot, and keys are joined.

Defined cases: rows without conv_id take no part; null roles and texts are empty; turns of one number are ordered by role,
then by the unit's bytes, null turns first; rows that repeat are further turns; an empty table has no nodes, not even a
root; other columns are ignored. A turn of any length is hashed whole. A path is one value of a row, so a conversation may
have 100 million turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffles, slices, table

UNIT = 20
#: Units in a container; heads that may burst at once by broadcast; units that a burst follows at most; ids in a piece.
LIMIT, MOST_HEADS, FOLLOWED, PIECE = 1 << 15, 1 << 14, 64, 8_192
#: Conversations of one block share the first turns of the block's first; how many follows from a conversation's id.
BLOCK, SHARED = 20, 4
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def units(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and unit of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    unit = F.concat(digest, F.unhex(F.lpad(F.hex(words), 8, "0")))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), unit.alias("unit"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id and path of each conversation, its first turns replaced by those of its block's first conversation. turns: of units().

    Blocks are dealt out by id and read in order; a task holds one path and the few turns that a block shares.
    """
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    own = turns.select(base.alias("base"), (F.col("conv_id") != base).alias("later"), "conv_id", "turn", "role", "unit", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int").alias("h"))
    order = ["base", "later", "conv_id", F.asc_nulls_first("turn"), "role", "unit"]

    def run(batches):
        conv, block, first, path, h = None, None, [], [], 0

        def ended():
            if conv == block:
                first[:] = path[: SHARED - 1]
            return b"".join(path if conv == block else first[:h] + path[h:])

        for batch in batches:
            ids, paths = [], []
            for b, c, u, k in zip(*(batch.column(n).to_pylist() for n in ("base", "conv_id", "unit", "h"))):
                if c != conv:
                    if conv is not None:
                        ids.append(conv)
                        paths.append(ended())
                    if b != block:
                        first.clear()
                    conv, block, h, path = c, b, k, []
                path.append(u)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.binary())], ["conv_id", "path"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([ended()], pa.binary())], ["conv_id", "path"])

    dealt = own.repartition(shuffles(turns), "base").sortWithinPartitions(*order)
    return dealt.select("base", "conv_id", "unit", "h").mapInArrow(run, "conv_id long, path binary")


def _hashed(rows, joined: bool):
    """Runs of one `whole`: pieces of ids (joined: False), or the hash over a group's pieces."""
    key, first, n, text, sha = None, None, 0, [], None

    def out():
        if joined:
            return key, first, n, sha.hexdigest()
        return key, first, n, ",".join(text)

    for batch in rows:
        made = []
        for w, c, m, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if w != key or (not joined and len(text) == PIECE):
                if key is not None:
                    made.append(out())
                key, first, n, text, sha = w, c, 0, [], hashlib.sha256()
            elif joined:
                sha.update(b",")
            n += m
            if joined:
                sha.update(t.encode())
            else:
                text.append(str(c))
        yield pa.RecordBatch.from_pylist([dict(zip("wcmt", x)) for x in made], pa.schema([("w", pa.binary()), ("c", pa.int64()), ("m", pa.int64()), ("t", pa.string())]))
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip("wcmt", out()))], pa.schema([("w", pa.binary()), ("c", pa.int64()), ("m", pa.int64()), ("t", pa.string())]))


def sequences(paths: DataFrame) -> DataFrame:
    """Each different path once: rep (the smallest conv_id), weight (conversations), ends (the hash of their ids) and path. paths: conv_id, path."""
    n, schema = shuffles(paths), "w binary, c long, m long, t string"
    ids = paths.select(F.unhex(F.sha2("path", 256)).alias("w"), F.col("conv_id").alias("c"), F.lit(1).cast("long").alias("m"), F.lit("").alias("t"))
    pieces = ids.repartitionByRange(n, "w", "c").sortWithinPartitions("w", "c").mapInArrow(lambda b: _hashed(slices(b, 10_000), False), schema)
    groups = pieces.repartition(n, "w").sortWithinPartitions("w", "c").mapInArrow(lambda b: _hashed(slices(b, 100), True), schema)
    groups = groups.select(F.col("c").alias("rep"), F.col("m").alias("weight"), F.col("t").alias("ends"))
    return groups.join(paths.withColumnRenamed("conv_id", "rep"), "rep")


def _words(unit: Column) -> Column:
    return F.conv(F.hex(F.substring(unit, 17, 4)), 16, 10).cast("long")


def _burst(rows: DataFrame, over: DataFrame, small: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The heads of the containers in `over`, the rows of the containers beneath them, and the rows of all others."""
    keys = over.select("key")
    keys = F.broadcast(keys) if small else keys  # small: fewer than MOST_HEADS
    settled = rows.join(keys, "key", "left_anti")
    inside = rows.join(keys, "key", "left_semi")
    ahead = F.expr(f"substring(path, at + 1, {UNIT * FOLLOWED})")
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(FOLLOWED)), lambda i: (F.least(F.length("lo"), F.length("hi")) >= i * UNIT) & (F.substr("lo", F.lit(1), i * UNIT) == F.substr("hi", F.lit(1), i * UNIT))))
    heads = inside.groupBy("key").agg(F.min(ahead).alias("lo"), F.max(ahead).alias("hi"), F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.first("at").alias("at"), F.first("up").alias("up"), F.first("up_key").alias("up_key"), F.first("top").alias("top"))
    heads = cut(heads.withColumn("follows", same).drop("hi"))
    passed = heads.select("key", F.col("conv_id").alias("head"), (F.col("at") + UNIT * F.col("follows")).alias("to"))
    passed = inside.drop("up", "up_key", "at", "top").join(F.broadcast(passed) if small else passed, "key")
    ended = passed.where(F.length("path") == F.col("to")).select("key", "ends")
    beneath = passed.where(F.length("path") > F.col("to"))
    beneath = beneath.select("rep", "weight", "ends", "path", (F.col("to") + UNIT).alias("at"), F.col("head").alias("up"), F.col("key").alias("up_key"))
    return cut(heads.join(ended, "key", "left")), cut(_keyed(beneath)), settled


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with their container's key and the number of words in its top's turn."""
    return rows.withColumns({"key": F.unhex(F.md5(F.expr("substring(path, 1, at)"))), "top": F.when(F.col("at") > 0, _words(F.expr(f"substring(path, at - {UNIT - 1}, {UNIT})"))).otherwise(F.lit(0).cast("long"))})


def _sweep(batches):
    """Nodes of containers whose paths arrive in order. Open nodes are those on the last path; each holds its closed children until it closes itself."""
    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "up_key"]
    schema = pa.schema([(n, pa.int64()) for n in names[:7]] + [("ends", pa.string()), ("up_key", pa.binary())])
    out: list[tuple] = []
    stack: list[list] = []  # depth, conv, n, children, leaves, saved, words, ends, rows of children
    key = top = last = None

    def close():
        depth, conv, n, children, leaves, saved, words, ends, rows = stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * words
        out.extend((d, c, conv, *rest, None) for d, c, *rest in rows)
        row = (depth, conv, n, children, leaves, saved, ends)
        if not stack:
            out.append((depth, conv, top[0], *row[2:], top[1]))
            return
        above = stack[-1]
        above[1] = conv if above[1] is None else min(above[1], conv)
        above[2] += n
        above[3] += 1
        above[4] += leaves
        above[5] += saved
        above[8].append(row)

    def batch_out():
        made = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * len(names), schema)], schema=schema)
        out.clear()
        return made

    for batch in slices(batches, 2_000):
        for k, at, up, up_key, words, rep, weight, ends, path in zip(*(batch.column(n).to_pylist() for n in ("key", "at", "up", "up_key", "top", "rep", "weight", "ends", "path"))):
            if k != key:
                while stack:
                    close()
                key, top, last = k, (up, up_key), b""
                stack.append([at // UNIT, None, 0, 0, 0, 0, words, None, []])
            depth, most = at // UNIT, min(len(path), len(last)) // UNIT
            while depth < most and path[depth * UNIT : depth * UNIT + UNIT] == last[depth * UNIT : depth * UNIT + UNIT]:
                depth += 1
            while stack[-1][0] > depth:
                close()
            for d in range(depth, len(path) // UNIT):
                stack.append([d + 1, None, 0, 0, 0, 0, int.from_bytes(path[d * UNIT + 16 : d * UNIT + UNIT], "big"), None, []])
            end = stack[-1]
            end[1], end[2], end[7] = rep if end[1] is None else min(end[1], rep), end[2] + weight, ends
            last = path
        yield batch_out()
    while stack:
        close()
    yield batch_out()


def trie(paths: DataFrame, limit: int = LIMIT, most_heads: int = MOST_HEADS) -> DataFrame:
    """A row for each node: depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. paths: conv_id and path (units one after the other)."""
    rows = sequences(cut(paths.select("conv_id", "path"))).withColumns({"at": F.lit(0), "up": F.lit(None).cast("long"), "up_key": F.lit(None).cast("binary")})
    rows = cut(_keyed(rows))
    total = rows.agg(F.sum(F.length("path"))).first()[0] or 0
    settled, bursts = [], []
    for most, small in ((max(limit, total // UNIT // most_heads), True), (limit, False)):
        while True:
            sizes = rows.groupBy("key").agg(F.sum((F.length("path") - F.col("at")) / UNIT).alias("units"), F.count("*").alias("n"))
            over = cut(sizes.where((F.col("units") > most) & (F.col("n") > 1)))
            if over.isEmpty():
                break
            heads, rows, rest = _burst(rows, over, small)
            bursts.append(heads)
            settled.append(rest)
    for s in settled:
        rows = rows.unionByName(s)
    ordered = rows.repartition(shuffles(paths), "key").sortWithinPartitions("key", "path")
    nodes = ordered.mapInArrow(_sweep, _NODE + ", up_key binary")
    tops = None
    if bursts:
        nodes = cut(nodes)
        tops = nodes.where("up_key IS NOT NULL").select("up_key", "n_leaves", "saved_tokens")
    for heads in reversed(bursts):
        sums = tops.groupBy(F.col("up_key").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        heads = heads.join(sums, "key")
        # the head and the nodes that it is followed by without a choice, the number of words in each one's turn
        words = F.transform(F.sequence(F.lit(0), F.col("follows")), lambda j: F.when(j == 0, F.col("top")).otherwise(_words(F.substr("lo", (j - 1) * UNIT + 1, F.lit(UNIT)))))
        heads = heads.withColumn("words", words).select("*", F.explode(F.sequence(F.lit(0), F.col("follows"))).alias("j"))
        below, end = F.slice("words", F.col("j") + 1, F.size("words")), F.col("j") == F.col("follows")
        heads = cut(
            heads.select(
                (F.col("at") / UNIT + F.col("j")).cast("long").alias("depth"),
                "conv_id",
                F.when(F.col("j") == 0, F.col("up")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
                "n_convs",
                F.when(end, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
                "n_leaves",
                (F.col("saved") + (F.col("n_convs") - 1) * F.aggregate(below, F.lit(0).cast("long"), lambda a, x: a + x)).alias("saved_tokens"),
                F.when(end, F.col("ends")).alias("ends"),
                F.when(F.col("j") == 0, F.col("up_key")).alias("up_key"),
            )
        )
        nodes = nodes.unionByName(heads)
        tops = tops.unionByName(heads.where("up_key IS NOT NULL").select("up_key", "n_leaves", "saved_tokens"))
    return nodes.drop("up_key").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NO_ENDS))).drop("ends")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie(rebuilt(units(table(spark, sf_dir, "conversations"))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: list_reduce(list_prepend(xor(a, x), list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda b, i: xor(b >> 1, CASE WHEN b % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)))"

ORACLE = rf"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT ids.c, 0 AS own, t.k, role, txt FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND t.k <= ids.h UNION ALL SELECT ids.c, 1, t.k, role, txt FROM ids JOIN t ON t.c = ids.c AND t.k > ids.h),
p AS (SELECT c, row_number() OVER w AS depth, string_agg(md5(CAST(length(role) AS VARCHAR) || ':' || role || txt), '') OVER w AS path, len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) AS words FROM u WINDOW w AS (PARTITION BY c ORDER BY own, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT c, depth, path, words FROM p UNION ALL SELECT c, 0, '', 0 FROM ids),
lens AS (SELECT c, max(depth) AS n FROM m GROUP BY c),
v AS (SELECT path, depth, min(m.c) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(CASE WHEN depth = n THEN CAST(m.c AS VARCHAR) END, ',' ORDER BY m.c), '') AS ends FROM m JOIN lens ON lens.c = m.c GROUP BY path, depth),
e AS (SELECT v.path, v.depth, v.conv_id, v.n_convs, v.words, v.ends, a.conv_id AS parent_conv_id FROM v LEFT JOIN v a ON v.depth = a.depth + 1 AND substr(v.path, 1, 32 * a.depth) = a.path),
kids AS (SELECT substr(path, 1, 32 * (CAST(depth AS INTEGER) - 1)) AS path, count(*) AS k FROM v WHERE depth > 0 GROUP BY 1),
f AS (SELECT e.path, e.depth, e.conv_id, e.parent_conv_id, n_convs, words, ends, coalesce(k, 0) AS n_children FROM e LEFT JOIN kids ON kids.path = e.path),
s AS (SELECT m.path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * f.words) AS saved FROM f JOIN m ON m.c = f.conv_id AND m.depth <= f.depth GROUP BY m.path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN s ON s.path = f.path
"""
