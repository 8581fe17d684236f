"""Document fingerprints: bottom-k sketches of hashed shingles, built and compared with SQL functions only.

A fingerprint holds the `SIZE` smallest distinct 64-bit hashes of a text's shingles (five lower-cased words; a shorter
text is one shingle), in order. Sketches of parts merge into that of the whole, and give unbiased estimates of
resemblance, containment and the number of distinct shingles; where a text has fewer shingles than that, they are exact.

Defined cases: null and empty texts, and texts without words, have the empty sketch; two empty sketches are alike (1),
an empty one and another are not (0); equal texts have equal sketches. Rows are ordered by doc_id, nulls last in
descending order; rows that share a doc_id are ordered by a hash of the text, and rows that repeat both are one document
whose results each of them gets. A single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_order, table, with_neighbours

SIZE, WORDS = 64, 5
FIRST_ID = -(1 << 63)


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch(hashes: Column, size: int = SIZE, words: int = WORDS) -> Column:
    """The bottom-k sketch of word_hashes(), as an array of longs."""
    n = F.size(hashes)
    # a hash of the window's hashes, with each at its place
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (words - 1))), lambda i: F.xxhash64(F.slice(hashes, i, words)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array_sort(F.array_distinct(windows)), 1, size))


def with_sketch(df: DataFrame, text: str, name: str, size: int = SIZE, words: int = WORDS) -> DataFrame:
    """df with the sketch of a text column. The hashes are a column of their own, so that each word is hashed once."""
    return df.withColumn("_hashes", word_hashes(F.col(text))).withColumn(name, sketch(F.col("_hashes"), size, words)).drop("_hashes")


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of what both sketches stand for."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated share of shingles in common, among all of both."""
    both = merge(a, b, size)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """The estimated number of distinct shingles."""
    last = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / last)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """The estimated share of a's shingles that b has."""
    union = distinct_count(merge(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, size) * union / distinct_count(a, size)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def linked(keys: DataFrame) -> DataFrame:
    """Distinct keys (o, h, n) with the key and n of the document before: the one whose next document this is, by falling o and rising h; before the first comes the last."""
    rows = in_order(keys.withColumn("down", F.bitwise_not("o")), "down", "h")
    return with_neighbours(rows, F.struct("o", "h", "n"), "down", "h", wrap=True).select("o", "h", F.col("previous").alias("before"))


def compare(docs: DataFrame, size: int = SIZE, words: int = WORDS) -> DataFrame:
    """doc_id, the text's sketch, the edited text, its sketch, and the next document's id, length and sketch, for each row of docs (doc_id, text).

    Both sides of the last join read the same columns of the first, so Spark shuffles the texts once.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)).alias("o"), F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n"), "text")
    links = cut(linked(rows.groupBy("o", "h").agg(F.first("n").alias("n"))))
    drawn = with_sketch(rows, "text", "sketch", size, words).join(links, ["o", "h"])
    # what the document before needs of this one: its first code points, as many as a third of its own text, and the sketch
    heads = drawn.select(F.col("before.o").alias("o"), F.col("before.h").alias("h"), F.substring("text", F.lit(1), F.floor(F.col("before.n") / 3).cast("int")).alias("head"), F.col("sketch").alias("next_sketch"), F.col("doc_id").alias("next_doc_id"), F.col("n").alias("next_n_chars"))
    heads = heads.dropDuplicates(["o", "h"])  # rows that repeat a document
    third = F.floor(F.col("n") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n").cast("int") - third), F.col("head"))
    both = drawn.select("doc_id", "o", "h", "n", "text", "sketch").join(heads, ["o", "h"]).select("doc_id", F.col("n").alias("n_chars"), "sketch", "next_sketch", "next_doc_id", "next_n_chars", edited.alias("edited"))
    return with_sketch(both, "edited", "edited_sketch", size, words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
        "next_doc_id",
        "next_n_chars",
    )
