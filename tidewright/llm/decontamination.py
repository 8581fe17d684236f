"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and benchmark items are lower-cased (A-Z) and reduced to words (digits, letters, anything beyond ASCII), joined
by one space. Each window of `window` consecutive words of an item, or the whole of a shorter item, is a pattern. A
table of shifts by blocks of the text's bytes tells how far the search may jump; where the shift is 0, the bucket of
the block's patterns is compared directly. Every word that lies in an occurrence is hit.

Patterns are sent to the executors in sets of at most `set_patterns`. A benchmark of more patterns takes a pass over the
rows for each set: what a pass has found is written before the next set is sent, and the set before is removed, so driver
and executors hold one set at a time, whatever the size of the benchmark.

Defined cases: null and empty texts have no words and no hits; items without id or words are not searched for; items
that share a window each count; rows that repeat an item count once; repeated documents are reported alike; a text of
any length is searched whole, in a step of its own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shielded, table, texts_of, with_columns

WINDOW, SET_PATTERNS, BLOCK = 10, 100_000, 8
_keep = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def normal(raw: bytes) -> bytes:
    """The words of raw, a space before, between and after them."""
    return b" " + b" ".join(raw.translate(_keep).split()) + b" "


class Search:
    """Wu-Manber over patterns of any lengths; short patterns have tables of their own, as the shortest bounds the jump."""

    def __init__(self, patterns):
        lengths = sorted({len(p) for p in patterns})
        classes, low = [], None
        for n in lengths:
            if low is None or n > 2 * low:
                low = n
                classes.append((n, []))
            classes[-1][1].extend(p for p in patterns if len(p) == n)
        self.tables = [self._table(m, ps) for m, ps in classes]

    @staticmethod
    def _table(m: int, patterns: list[bytes]):
        b = max(1, min(BLOCK, m // 2))
        shift: dict[bytes, int] = {}
        bucket: dict[bytes, list[bytes]] = {}
        for p in patterns:
            for end in range(b, m + 1):
                block = p[end - b : end]
                shift[block] = min(shift.get(block, m), m - end)
            bucket.setdefault(p[m - b : m], []).append(p)
        return m, b, m - b + 1, shift, bucket

    def find(self, text: bytes):
        """(position, pattern) of every occurrence."""
        for m, b, most, shift, bucket in self.tables:
            at, end, jump = m, len(text), shift.get
            while at <= end:
                block = text[at - b : at]
                by = jump(block, most)
                if by:
                    at += by
                    continue
                for p in bucket[block]:
                    if text.startswith(p, at - m):
                        yield at - m, p
                at += 1


def patterns_of(raw: bytes, window: int = WINDOW) -> list[bytes]:
    words = normal(raw).split()
    n = min(window, len(words))
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(len(words) - n + 1)] if n else []


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_patterns: int = SET_PATTERNS) -> DataFrame:
    """docs with n_words, spans (disjoint half-open ranges of hit words, flattened) and items (ids with an occurring window, as sorted strings)."""
    spark = docs.sparkSession

    def split(batches):
        for batch in batches:
            ids, out_ids, out = batch.column(0).to_pylist(), [], []
            for i, text in zip(ids, batch.column(1).to_pylist()):
                for p in set(patterns_of((text or "").encode(), window)):
                    out_ids.append(i)
                    out.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.string()), pa.array(out, pa.binary())], ["item", "pattern"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null")
    found = items.mapInArrow(split, "item string, pattern binary").groupBy("pattern").agg(F.collect_set("item").alias("items"))
    out = docs
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    earlier = None
    pending: dict[bytes, list[str]] = {}

    def add(out, own, earlier):
        shared = spark.sparkContext.broadcast(own)
        tables: list[Search] = []

        def make(batch, data, starts):
            own = shared.value
            if not tables:
                tables.append(Search(list(own)))
            before = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()) if earlier else iter(lambda: ([], []), None)
            counts, spans, items = [], [], []
            for raw, (old_spans, old_items) in zip(texts_of(data, starts), before):
                text = normal(raw)
                hits, ids, last, words = [[a, b] for a, b in zip(old_spans[::2], old_spans[1::2])], set(old_items), 0, 0
                for at, p in sorted(tables[0].find(text)):
                    words += text.count(b" ", last, at)
                    last = at
                    ids.update(own[p])
                    hits.append([words, words + p.count(b" ") - 1])
                merged: list[list[int]] = []
                for a, b in sorted(hits):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                counts.append(max(0, text.count(b" ") - 1) if len(text) > 2 else 0)
                spans.append([x for s in merged for x in s])
                items.append(sorted(ids))
            return {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}

        return with_columns(out, make, fields), shared

    for r in found.toLocalIterator():
        pending[bytes(r["pattern"])] = sorted(r["items"])
        if len(pending) == set_patterns:
            out, shared = add(out, pending, earlier)
            out, earlier, pending = cut(out), True, {}
            shared.destroy()
    if pending or not earlier:
        out = add(out, pending, earlier)[0]
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), F.lit(0).cast("long"), lambda n, i: n + F.get("spans", i + 1) - F.get("spans", i))
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("spans") > 0, n_hit).otherwise(F.lit(0)).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a window of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    return shielded(docs, ("doc_id", "text"), lambda rows: find_spans(rows, benchmark).where(F.size("spans") == 0))


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
ip AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS p FROM (SELECT item, w, n, unnest(range(len(w) - n + 1)) AS i FROM il)),
ln AS (SELECT DISTINCT n FROM ip),
dp AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS p FROM (SELECT r, w, n, unnest(range(len(w) - n + 1)) AS i FROM dw, ln WHERE len(w) >= n)),
hit AS (SELECT dp.r, dp.i, dp.n, ip.item FROM dp JOIN ip ON dp.n = ip.n AND dp.p = ip.p),
pos AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
