"""Rows that share a doc_id and differ in text are documents of their own, however many they are."""

from pyspark.sql import functions as F

from tidewright.llm import chunk_dedup, suffix_dedup


def alike_in_24_bits(spark):
    """Two texts without common passages whose hashes agree in their low 24 bits."""
    texts = spark.range(40_000).select(F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)), 256) for k in range(6)]).alias("text"))
    tagged = texts.groupBy(F.pmod(F.xxhash64("text"), F.lit(1 << 24)).alias("tag")).agg(F.sort_array(F.collect_list("text")).alias("x")).where("size(x) > 1")
    return tagged.orderBy("tag").first()["x"][:2]


def test_texts_of_one_id_are_told_apart(spark):
    a, b = alike_in_24_bits(spark)
    assert a != b
    docs = spark.createDataFrame([(1, a), (None, a), (None, b), (None, b)], "doc_id long, text string")
    kept = sorted((r["doc_id"] is None, r["kept"], r["text"]) for r in chunk_dedup.remove_repeats(docs).collect())
    assert kept == sorted([(False, a, a), (True, "", a), (True, b, b), (True, b, b)])
    found = sorted((r["doc_id"] is None, bytes(r["kept"]).decode()) for r in suffix_dedup.dedup(docs).collect())
    assert found == sorted([(False, a), (True, ""), (True, b), (True, b)])


def test_second_text_of_one_id_loses_what_the_first_holds(spark):
    a, b = alike_in_24_bits(spark)
    docs = spark.createDataFrame([(None, a), (None, a[:200] + b), (None, b)], "doc_id long, text string")
    left = sum(len(r["kept"]) for r in suffix_dedup.dedup(docs).collect())
    assert left == len(a) + len(b)
