"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's bytes (each step shifts it by one bit and adds a random number for the byte, so it depends
on the last 32 bytes). A chunk ends where the hash's first MASK_BITS bits are 0, no sooner than LEAST and no later than
MOST bytes from its start, and never inside a character. As ends depend on content, what stands before a passage, or is
inserted into it, shifts no more than the chunks around it. Chunks are matched by a 96-bit digest; a chunk is a repeat
unless it is the first of its digest (by doc_id, then position). Runs of repeats of RUN bytes or more are removed:
shorter ones are phrases that texts share by chance.

Defined cases: null and empty texts have no chunks; a null doc_id comes after all others; rows that repeat doc_id and
text are one document and each get its result; a text that consists of repeats ends up empty; repeats within a text
count; a text of any length is taken whole, in a step of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, Spans, cut, ordered_id, packed, shielded, signed, steps, table, with_columns

LEAST, MOST, MASK_BITS, SIZE_BITS, RUN, FLUSH_CHUNKS = 24, 96, 4, 7, 64, 1_000_000
GEAR = (BYTE_CODES[2] >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window: 1, 2, 4 ... 32 bytes. Nothing stands before a text."""
    at = np.arange(len(data)) + 31 * np.repeat(np.arange(1, len(starts)), np.diff(starts))
    h = np.zeros(len(data) + 31 * len(starts), np.uint32)
    h[at] = GEAR[data]
    width = 1
    while width < 32:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h[at]


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks end, and how many each text has."""
    cont = (data & 0xC0) == 0x80
    stop = (gear_hash(data, starts) >> np.uint32(32 - MASK_BITS)) == 0
    stop[:-1] &= ~cont[1:]
    stops = np.flatnonzero(stop) + 1
    cuts = np.searchsorted(stops, starts, "right")
    stops = stops.tolist()
    ends: list[int] = []
    counts = np.zeros(len(starts) - 1, np.int64)
    for t, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        before, at = len(ends), a
        for stop_at in stops[cuts[t] : cuts[t + 1]] + [b]:
            while stop_at - at > MOST:
                end = at + MOST
                while cont[end]:
                    end -= 1
                ends.append(end)
                at = end
            if stop_at - at >= LEAST or stop_at == b > at:
                ends.append(stop_at)
                at = stop_at
        counts[t] = len(ends) - before
    return np.array(ends, np.int64), counts


def spans_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks start and end, and how many each text has."""
    ends, counts = chunk_ends(data, starts)
    begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if len(ends):
        firsts = np.cumsum(counts) - counts
        begin[firsts[counts > 0]] = starts[:-1][counts > 0]
    return begin, ends, counts


def hashes_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each chunk: 64 bits of one hash, and 32 bits of another with the chunk's size behind them."""
    second = Spans(data, 1).hash(begin, end) >> np.uint64(32)
    return signed(Spans(data, 0).hash(begin, end)), signed(second << np.uint64(SIZE_BITS) | (end - begin).astype(np.uint64))


def chunks(docs: DataFrame) -> DataFrame:
    """o, t, start, c1 and c2 of each chunk. docs: o and t (what identifies a document), text."""

    def run(batches):
        for batch, data, starts in steps(batches):
            begin, end, counts = spans_of(data, starts)
            row = np.repeat(np.arange(len(counts)), counts)
            c1, c2 = hashes_of(data, begin, end)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("o").take(take), batch.column("t").take(take), pa.array((begin - starts[row]).astype(np.int32)), pa.array(c1), pa.array(c2)], ["o", "t", "start", "c1", "c2"])

    return docs.select("o", "t", "text").mapInArrow(run, "o long, t long, start int, c1 long, c2 long")


def text_tag():
    """The text's hash, all 64 bits, which tells apart rows that share a doc_id: one key, such as null, may hold millions of texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def digests(docs: DataFrame) -> DataFrame:
    """c1, c2 and n of the chunks of all texts. Chunks that repeat within what a task sees at once make one row."""

    def run(batches):
        held, size = [], 0

        def settle():
            c1, c2 = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((c2, c1))
            c1, c2 = c1[order], c2[order]
            new = np.ones(len(c1), bool)
            new[1:] = (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
            at = np.flatnonzero(new)
            return pa.RecordBatch.from_arrays([pa.array(c1[at]), pa.array(c2[at]), pa.array(np.diff(np.append(at, len(c1))).astype(np.int32))], ["c1", "c2", "n"])

        for batch, data, starts in steps(batches):
            begin, end, _ = spans_of(data, starts)
            held.append(hashes_of(data, begin, end))
            size += len(begin)
            if size > FLUSH_CHUNKS:
                yield settle()
                held, size = [], 0
        if size:
            yield settle()

    return docs.select("text").mapInArrow(run, "c1 long, c2 long, n int")


def repeats(docs: DataFrame) -> DataFrame:
    """o, t and repeats (start, size and the document o of the first copy of each repeated chunk). docs: o, t, text.

    Digests are counted first, in few bytes; only chunks whose digest repeats are looked at further. What is joined to a
    count or a first place is shuffled by that join (both are written before), so Spark can split the rows of a chunk
    that very many texts share.
    """
    many = cut(digests(docs).groupBy("c1", "c2").agg(F.sum("n").alias("n")).where("n > 1").select("c1", "c2"))
    place = F.struct("o", "t", "start")
    found = cut(chunks(docs).join(many, ["c1", "c2"]))
    first = cut(found.groupBy("c1", "c2").agg(F.min(place).alias("first")))
    later = found.join(first, ["c1", "c2"]).where(place != F.col("first"))
    return later.groupBy("o", "t").agg(F.collect_set(F.struct("start", F.col("c2").bitwiseAND((1 << SIZE_BITS) - 1).cast("int").alias("size"), F.col("first.o").alias("source"))).alias("repeats"))


def runs(found: list, least: int = RUN) -> list[tuple[int, int, set]]:
    """Runs of adjoining repeats of `least` bytes or more: start, end, and the documents of the first copies."""
    out: list[list] = []
    for x in sorted(found, key=lambda x: x["start"]):
        if out and out[-1][1] == x["start"]:
            out[-1][1] = x["start"] + x["size"]
            out[-1][2].add(x["source"])
        elif not out or x["start"] >= out[-1][1]:
            out.append([x["start"], x["start"] + x["size"], {x["source"]}])
    return [tuple(x) for x in out if x[1] - x[0] >= least]


FIELDS = [T.StructField("kept", T.StringType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("sources", T.ArrayType(T.LongType()))]


def remove_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with kept (the text without repeats), n_removed (bytes), n_spans and sources (the doc_ids with the first copies)."""
    own = {"o": "_o", "t": "_t", "repeats": "_repeats"}
    rows = docs.withColumns({own["o"]: ordered_id(key), own["t"]: text_tag()})
    found = repeats(rows.select(F.col("_o").alias("o"), F.col("_t").alias("t"), "text")).withColumnsRenamed(own)
    joined = packed(rows).join(found, ["_o", "_t"], "left")

    def make(batch, data, starts):
        raw = data.tobytes()
        kept, removed, spans, sources = [], [], [], []
        nulls = batch.column("text").is_null().to_pylist()
        for null, a, b, found in zip(nulls, starts[:-1].tolist(), starts[1:].tolist(), batch.column("_repeats").to_pylist()):
            gone = runs(found) if found else []
            at, parts = a, []
            for i, j, _ in gone:
                parts.append(raw[at : a + i])
                at = a + j
            parts.append(raw[at:b])
            kept.append(None if null else b"".join(parts).decode("utf-8", "replace"))
            removed.append(sum(j - i for i, j, _ in gone))
            spans.append(len(gone))
            sources.append(sorted(set().union(*(s for _, _, s in gone))))
        return {"kept": pa.array(kept, pa.string()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "sources": pa.array(sources, pa.list_(pa.int64()))}

    return with_columns(joined, make, FIELDS, small=True).drop("_o", "_t", "_repeats")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_removed",
        "n_spans",
        F.col("sources").alias("source_doc_ids"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose texts have lost what earlier texts hold; n_chars follows."""

    def work(rows: DataFrame) -> DataFrame:
        out = remove_repeats(rows).withColumn("text", F.col("kept"))
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return out

    return shielded(docs, ("doc_id", "text", "n_chars"), work)
