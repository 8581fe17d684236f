"""Monthly outputs that are built once: a commit table of months, plans by anti-join, and replacement of partial ones.

A month's rows are written first and its commit after them, so a run that dies between leaves a month that the next run
plans again and replaces. What is there is read from the partitions themselves: a month that was committed and has since
gone is planned as well. Commits are small files of their own, one for each run, and the last for a month counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMITS = "symbol string, ym string, n_rows long, source_rows long, complete boolean, run long"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The last commit of each month: symbol, ym, n_rows, source_rows, complete (no later change is expected) and run."""
    try:
        rows = spark.read.schema(COMMITS).parquet(f"{path}/_commits/*")
    except AnalysisException:  # there has been no run
        return spark.createDataFrame([], COMMITS)
    last = Window.partitionBy("symbol", "ym").orderBy(F.desc("run"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def present(spark: SparkSession, path: str) -> DataFrame:
    """symbol and ym of the months that have rows now."""
    try:
        return spark.read.schema("symbol string, ym string").option("basePath", f"{path}/rows").parquet(f"{path}/rows/symbol=*/ym=*").select("symbol", "ym").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "symbol string, ym string")


def source_months(source: DataFrame, ts: str, later: int = 2) -> DataFrame:
    """symbol, ym, source_rows and complete: whether at least `later` later months of the symbol have come, so that the month is final."""
    months = source.groupBy("symbol", F.date_format(ts, "yyyy-MM").alias("ym")).agg(F.count("*").alias("source_rows"))
    newer = F.count("*").over(Window.partitionBy("symbol").orderBy(F.desc("ym")).rowsBetween(Window.unboundedPreceding, -1))
    return months.withColumn("complete", newer >= later)


def plan(source: DataFrame, path: str, ts: str, later: int = 2) -> DataFrame:
    """The months of source to build: those without a commit, whose commit was partial and whose source has changed or is final now, or whose rows have gone."""
    spark = source.sparkSession
    done = commits(spark, path).select("symbol", "ym", F.col("source_rows").alias("_rows"), F.col("complete").alias("_complete"))
    there = present(spark, path).withColumn("_there", F.lit(True))
    months = source_months(source, ts, later).join(done, ["symbol", "ym"], "left").join(there, ["symbol", "ym"], "left")
    settled = F.col("_there") & (F.col("_complete") | ((F.col("source_rows") == F.col("_rows")) & ~F.col("complete")))
    return months.where(~F.coalesce(settled, F.lit(False))).select("symbol", "ym", "source_rows", "complete")


def write_new_months(source: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], ts: str = "ts", bar_ts: str = "bar_ts", later: int = 2) -> int:
    """Build and write the planned months of source under path, commit them, and give their number. build(rows of those months) returns rows with symbol and bar_ts.

    Rows of a planned month take the place of all that is there of it; other months are not touched. A committed month that
    is complete is never built again while its rows are there, even if late rows come for it.
    """
    spark = source.sparkSession
    todo = plan(source, path, ts, later).persist()
    try:
        n = todo.count()
        if not n:
            return 0
        own = source.withColumn("ym", F.date_format(ts, "yyyy-MM")).join(todo.select("symbol", "ym"), ["symbol", "ym"], "left_semi").drop("ym")
        rows = build(own).withColumn("ym", F.date_format(bar_ts, "yyyy-MM"))
        rows.repartition("symbol", "ym").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "ym").parquet(f"{path}/rows")
        written = spark.read.parquet(f"{path}/rows").select(F.col("symbol").cast("string").alias("symbol"), F.col("ym").cast("string").alias("ym")).groupBy("symbol", "ym").agg(F.count("*").alias("n_rows"))
        run = (commits(spark, path).agg(F.max("run")).first()[0] or 0) + 1
        made = todo.join(written, ["symbol", "ym"], "left").select("symbol", "ym", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), F.col("source_rows").cast("long").alias("source_rows"), "complete", F.lit(run).cast("long").alias("run"))
        # a shuffle, as one task that reads all partitions of the windows and joins would hold all their sorters' memory at once
        made.repartition(1).write.mode("errorifexists").parquet(f"{path}/_commits/run-{run:09d}")  # a row for each planned month
        return n
    finally:
        todo.unpersist()


def read_built(spark: SparkSession, path: str) -> DataFrame:
    """The rows of committed months."""
    return spark.read.parquet(f"{path}/rows").join(commits(spark, path).select("symbol", "ym"), ["symbol", "ym"], "left_semi")


def finalised(spark: SparkSession, path: str) -> DataFrame:
    """Rows of months that are complete."""
    return spark.read.parquet(f"{path}/rows").join(commits(spark, path).where("complete").select("symbol", "ym"), ["symbol", "ym"], "left_semi")
