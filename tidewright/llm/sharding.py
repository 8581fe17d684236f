"""Sharding by extendible hashing.

A document's hash is the first KEY_BITS bits of the md5 of its key, then TEXT_BITS bits of the md5 of its text, which tell
apart rows that share a key. The directory is indexed by the hash's first bits. It starts as one bucket, and only a
bucket over the byte limit splits on one more bit, until every bucket fits.

Sizes are summed by prefix, ROUND_BITS bits at a time; the splits of those bits are read off the sums, and only rows of
buckets that are still too large go on to the next bits. So the directory is never gathered in one place, and each pass
shuffles sums, not rows.

Defined cases: a null key or text hashes as an empty one, and a null text has 0 bytes; an empty table has no shards;
repeated rows share a shard. A bucket of rows with equal hashes (rows that repeat key and text), or of one text over the
limit, can't be split by any bit and stays over the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LIMIT_BYTES, ROUND_BITS, KEY_BITS, TEXT_BITS = 1 << 20, 12, 36, 24


def _bits(value, n: int):
    return F.lpad(F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, n // 4), 16, 2), n, "0")


def hashed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bits (of the hash, as a text of 0 and 1) and n_bytes of each row."""
    return docs.select(F.col(key).alias("key"), F.concat(_bits(F.col(key), KEY_BITS), _bits(F.col(text), TEXT_BITS)).alias("bits"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))


def directory(rows: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """shard (the bits of a bucket) and shard_bytes. rows: bits, n_bytes."""
    last = KEY_BITS + TEXT_BITS
    open_ = rows.select("bits", "n_bytes", F.lit("").alias("prefix"))
    leaves = None
    for start in range(0, last, ROUND_BITS):
        end = start + ROUND_BITS
        cells = open_.groupBy("prefix", F.substring("bits", start + 1, ROUND_BITS).alias("next")).agg(F.sum("n_bytes").alias("n_bytes"))
        depth = F.explode(F.sequence(F.lit(0), F.lit(ROUND_BITS))).alias("depth")
        sums = cells.select("prefix", "next", "n_bytes", depth).groupBy("prefix", "depth", F.expr("substring(next, 1, depth)").alias("short")).agg(F.sum("n_bytes").alias("shard_bytes"))
        sums = cut(sums)
        over = sums.where((F.col("shard_bytes") > limit) & (F.col("depth") < ROUND_BITS))
        ends = sums.where((F.col("shard_bytes") <= limit) | ((F.col("depth") == ROUND_BITS) & F.lit(end == last)))
        # a bucket is a prefix that fits where the one a bit shorter doesn't
        split = over.select("prefix", (F.col("depth") + 1).alias("depth"), F.col("short").alias("above"))
        found = ends.where("depth > 0").withColumn("above", F.expr("substring(short, 1, depth - 1)")).join(split, ["prefix", "depth", "above"], "left_semi")
        if start == 0:
            found = ends.where("depth = 0").withColumn("above", F.lit("")).select(found.columns).unionByName(found)
        found = found.select(F.concat("prefix", "short").alias("shard"), "shard_bytes")
        leaves = found if leaves is None else leaves.unionByName(found)
        still = sums.where((F.col("depth") == ROUND_BITS) & (F.col("shard_bytes") > limit)).select(F.concat("prefix", "short").alias("prefix"))
        if end == last or still.isEmpty():
            return leaves
        open_ = rows.withColumn("prefix", F.substring("bits", 1, end)).join(still, "prefix").select("bits", "n_bytes", "prefix")
    return leaves


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """key, n_bytes, shard and shard_bytes of each row of docs."""
    rows = cut(hashed(docs, key, text))
    leaves = cut(directory(rows, limit))
    depths = sorted(r["depth"] for r in leaves.select(F.length("shard").alias("depth")).distinct().collect())  # at most KEY_BITS + TEXT_BITS + 1 numbers
    # a row's bits start with exactly one bucket's
    tries = rows.withColumn("shard", F.explode(F.array([F.substring("bits", 1, d) for d in depths] or [F.lit("")])))
    return tries.join(leaves, "shard").select(F.col("key").alias(key), "n_bytes", "shard", "shard_bytes")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """docs as Parquet, a folder for each shard. A shard is at most `limit` bytes of text, so it is one task's work."""
    leaves = cut(directory(cut(hashed(docs, key, text)), limit))
    depths = sorted(r["depth"] for r in leaves.select(F.length("shard").alias("depth")).distinct().collect())
    bits = F.concat(_bits(F.col(key), KEY_BITS), _bits(F.col(text), TEXT_BITS))
    tries = docs.withColumn("shard", F.explode(F.array([F.substring(bits, 1, d) for d in depths] or [F.lit("")])))
    tries.join(leaves.select("shard"), "shard", "left_semi").withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql_bits(value: str, digits: int) -> str:
    return f"array_to_string(list_transform(string_split(substr(md5(coalesce(CAST({value} AS VARCHAR), '')), 1, {digits}), ''), lambda c: lpad(bin(CAST('0x' || c AS INTEGER)), 4, '0')), '')"


ORACLE = f"""
WITH h AS (SELECT row_number() OVER () AS r, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, {_sql_bits("doc_id", KEY_BITS // 4)} || {_sql_bits("text", TEXT_BITS // 4)} AS bits FROM documents),
d AS (SELECT r, doc_id, n_bytes, bits, unnest(range({KEY_BITS + TEXT_BITS + 1})) AS depth FROM h),
s AS (SELECT r, doc_id, n_bytes, depth, substr(bits, 1, depth) AS shard, sum(n_bytes) OVER (PARTITION BY depth, substr(bits, 1, depth)) AS shard_bytes FROM d)
SELECT doc_id, n_bytes, arg_min(shard, depth) AS shard, CAST(arg_min(shard_bytes, depth) AS BIGINT) AS shard_bytes
FROM s WHERE shard_bytes <= {LIMIT_BYTES} OR depth = {KEY_BITS + TEXT_BITS} GROUP BY r, doc_id, n_bytes
"""
