"""Blocks of sequences are spread over tasks; commits of months come from a task of their own."""

from pyspark.sql import functions as F

from tidewright.operators import hmm as H


def test_one_symbols_blocks_are_many_tasks_work(spark):
    rows = spark.range(1, 4_001).select(F.lit("a").alias("symbol"), F.col("id").alias("seq"), F.rand(1).alias("x1"), F.rand(2).alias("x2"))
    cut = H.blocks(rows, ["x1", "x2"], 100)
    found = cut.withColumn("p", F.spark_partition_id()).orderBy("block").collect()
    assert len({r["p"] for r in found}) > 1
    assert [r["block"] for r in found if r["first"]] == [0] and [r["block"] for r in found if r["last"]] == [40]
    assert all(len(r["x"]) == 2 * len(r["seqs"]) for r in found) and sum(len(r["seqs"]) for r in found) == 4_000
