"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Rows that a task writes of the tables of a round.
TASK_ROWS = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, in no more partitions than these need: each task that writes leaves files, however few its rows are."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) for each node that has an edge. edges: a, b (longs).

    Each round ties nodes to the least neighbour, first from above, then from below; the number of rounds grows with the
    logarithm of the longest path. A node's neighbours are never gathered: minima are aggregated, written, and joined back;
    as the join then shuffles both sides, Spark can split the rows of a node that very many share. Joins are merges, so that
    no side goes through the driver, of whatever size it turns out to be. Rounds write Parquet, of whose size Spark needs no
    estimate: a checkpoint would keep that of its joins, a number whose digits double with every join of every round, until
    it alone fills the driver.
    """
    e = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    n = e.count()
    while n:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(gathered(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), 2 * n))
        # done when each node but the least of a component has one edge, to the least
        ends, going = least.agg(F.sum("n"), F.count_if((F.col("m") < F.col("u")) & (F.col("n") > 1))).first()
        if not going:
            break
        n = ends // 2
        least = least.select("u", F.least("u", "m").alias("m"))
        large = settled(gathered(both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n))
        low = settled(gathered(large.groupBy("u").agg(F.min("v").alias("m")), n))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settled(gathered(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n))
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
