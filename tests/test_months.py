"""Incremental months: a second run writes nothing, a lost month comes back, a partial one is replaced."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidewright.sources import months as N


def build(rows):
    return rows.groupBy("symbol", F.date_trunc("day", "ts").alias("bar_ts")).agg(F.sum("x").alias("total"), F.count("*").alias("n"))


@pytest.fixture
def source(spark):
    days = spark.range(0, 150).select(F.explode(F.array(F.lit("a"), F.lit("b/c"))).alias("symbol"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 86_400).alias("ts"), F.col("id").cast("double").alias("x"))
    return days.unionByName(days.where("symbol = 'a'"))


def files(tmp_path):
    return {str(p): p.stat().st_mtime_ns for p in (tmp_path / "out" / "rows").rglob("*.parquet")}


def total(spark, path):
    return {(r["symbol"], r["ym"]): (r["s"], r["c"]) for r in N.read_built(spark, path).groupBy("symbol", "ym").agg(F.sum("total").alias("s"), F.sum("n").alias("c")).collect()}


def test_second_run_writes_nothing(spark, source, tmp_path):
    path = f"{tmp_path}/out"
    assert N.write_new_months(source, path, build) == 10
    before, whole = files(tmp_path), total(spark, path)
    assert len(whole) == 10 and N.write_new_months(source, path, build) == 0 and files(tmp_path) == before
    done = {(r["symbol"], r["ym"]): r for r in N.commits(spark, path).collect()}
    assert done[("a", "2024-03")]["complete"] and not done[("a", "2024-04")]["complete"] and done[("a", "2024-01")]["n_rows"] == 31
    assert {r["ym"] for r in N.finalised(spark, path).select("ym").distinct().collect()} == {"2024-01", "2024-02", "2024-03"}


def test_lost_month_is_built_again(spark, source, tmp_path):
    path = f"{tmp_path}/out"
    N.write_new_months(source, path, build)
    before, whole = files(tmp_path), total(spark, path)
    shutil.rmtree(tmp_path / "out" / "rows" / "symbol=a" / "ym=2024-02")
    assert [tuple(r) for r in N.plan(source, path, "ts").select("symbol", "ym").collect()] == [("a", "2024-02")]
    assert N.write_new_months(source, path, build) == 1 and total(spark, path) == whole
    kept = {f: t for f, t in files(tmp_path).items() if "symbol=a/ym=2024-02" not in f}
    assert kept == {f: t for f, t in before.items() if "symbol=a/ym=2024-02" not in f}


def test_partial_month_is_replaced(spark, source, tmp_path):
    path = f"{tmp_path}/out"
    early = source.where("ts < '2024-03-10'")
    assert N.write_new_months(early, path, build) == 6
    assert total(spark, path)[("b/c", "2024-03")][1] == 9
    assert N.write_new_months(early, path, build) == 0
    # March goes on and April comes: January stays as it is
    assert sorted(tuple(r) for r in N.plan(source, path, "ts").select("symbol", "ym").collect()) == sorted((s, f"2024-0{m}") for s in ("a", "b/c") for m in (2, 3, 4, 5))
    january = {f: t for f, t in files(tmp_path).items() if "2024-01" in f}
    N.write_new_months(source, path, build)
    assert total(spark, path)[("b/c", "2024-03")][1] == 31 and {f: t for f, t in files(tmp_path).items() if "2024-01" in f} == january


def test_rows_without_commit_are_replaced(spark, source, tmp_path):
    """A run that died after writing, before its commit."""
    path = f"{tmp_path}/out"
    N.write_new_months(source, path, build)
    whole = total(spark, path)
    shutil.rmtree(tmp_path / "out" / "_commits")
    assert N.commits(spark, path).count() == 0 and N.read_built(spark, path).count() == 0
    assert N.write_new_months(source, path, build) == 10 and total(spark, path) == whole


def test_empty_source(spark, source, tmp_path):
    assert N.write_new_months(source.where("false"), f"{tmp_path}/out", build) == 0
