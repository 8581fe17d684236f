"""Typed files, signals, metrics and the joins that bring them together."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidewright.sources import files as W


@pytest.fixture
def prices(spark):
    return spark.range(0, 90).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("symbol"), (F.col("id") * 86_400_000).alias("timestamp"), *[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume", "realized_vol"))], F.col("id").cast("int").alias("high_time"), F.col("id").alias("low_time"), F.lit("x").alias("other"))


def test_round_trip_and_months(spark, prices, tmp_path):
    path = f"{tmp_path}/p"
    W.write_typed(prices, path, W.PRICES, F.timestamp_millis("timestamp"))
    back = W.read_prices(spark, path)
    assert back.columns == ["symbol", *W.PRICES.names] and [f.dataType for f in back.schema][1:] == [f.dataType for f in W.PRICES]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, W.checked(prices, W.PRICES).collect()))
    W.write_typed(prices.where("timestamp < 1000"), path, W.PRICES, F.timestamp_millis("timestamp"))
    assert W.read_prices(spark, path).count() < 90  # that month only has been replaced
    plan = W.read_typed(spark, path, W.PRICES, ["close"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<close:double>" in plan


def test_mismatches_are_named(spark, prices):
    with pytest.raises(W.SchemaMismatch, match="close .string, not double.*volume .missing"):
        W.checked(prices.withColumn("close", F.lit("1")).drop("volume"), W.PRICES)
    assert len(W.FEATURES) == 36 and W.FEATURES.names[:2] == ["start_time", "end_time"]


def test_signals(spark, tmp_path):
    one, two = f"{tmp_path}/s/one", f"{tmp_path}/s/two"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 0)], "symbol string, seq int, signal int").write.parquet(one)
    rows = W.read_signals(spark, one).collect()
    assert [(r["signal"], r["size"], r["stop_price"]) for r in rows] == [(1, 1.0, None), (0, 1.0, None)]
    spark.createDataFrame([("a", 3, -1, 0.0, 9.0), ("a", 4, 1, 0.5, 0.0)], "symbol string, seq int, signal int, size double, sl_price double").write.parquet(two)
    rows = {r["seq"]: r for r in W.read_signals(spark, f"{tmp_path}/s/*").collect()}
    assert [rows[i]["size"] for i in (1, 2, 3, 4)] == [1.0, 1.0, 1.0, 0.5] and rows[3]["stop_price"] == 9.0
    spark.createDataFrame([("a", 5, 2)], "symbol string, seq int, signal int").write.parquet(f"{tmp_path}/s/bad")
    with pytest.raises(W.SchemaMismatch):
        W.read_signals(spark, f"{tmp_path}/s/bad")


def test_metrics_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", math.inf, [1.0, math.nan], None)], "symbol string, pf double, equity array<double>, note string")
    W.write_metrics(df, f"{tmp_path}/m")
    line = next(p for p in (tmp_path / "m").iterdir() if p.name.startswith("part") and p.stat().st_size).read_text()
    assert json.loads(line) == {"symbol": "a", "pf": None, "equity": [1.0, None], "note": None}
    W.write_table(df.select("symbol", "pf"), f"{tmp_path}/t")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/t").columns == ["symbol", "pf"]


def test_names(spark):
    assert W.config_hash({"b": 1, "a": [2, 3]}) == W.config_hash({"a": [2, 3], "b": 1}) != W.config_hash({"a": [3, 2], "b": 1})
    assert W.hashed_path("/x/", "features", {}).startswith("/x/features-") and W.dataset_path("/x", "bars", "spot", "a", 4) == "/x/bars/market=spot/bars_per_day=4/symbol=a"
    config = spark.createDataFrame([("b", "spot", 1, True), ("a", "spot", 1, True), ("c", "futures", 0, True), ("d", "spot", 0, False)], "symbol string, market string, priority int, enabled boolean")
    assert [r[0] for r in W.enabled_symbols(config).collect()] == ["c", "a", "b"] and [r[0] for r in W.enabled_symbols(config, "d").collect()] == ["d"]


def test_joins(spark):
    bars = spark.createDataFrame([("a", 1, 10, 1.0), ("a", 2, 20, 2.0), ("a", 3, 30, 3.0)], "symbol string, seq long, start_time long, close double")
    features = spark.createDataFrame([("a", 10, 15, 9.0, 0.1, True), ("a", 10, 14, 9.0, 0.2, True), ("a", 20, 25, 9.0, 0.3, False), ("a", 40, 45, 9.0, 0.4, True)], "symbol string, start_time long, end_time long, close double, f double, is_primed boolean")
    rows = W.join_features(bars, features).collect()
    assert [(r["seq"], r["close"], r["f"]) for r in rows] == [(1, 1.0, 0.2)] and W.join_features(bars, features, False).count() == 2
    signals = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 1, 1)], "symbol string, seq long, signal int")
    both, missing = W.join_signals(signals, bars)
    assert both.count() == 2 and sorted(map(tuple, missing.collect())) == [("a", 0, 1), ("b", 1, 0)]
    assert W.join_signals(signals.where("symbol = 'a' AND seq < 3"), bars.where("seq < 3"))[1].count() == 0


def test_event_windows(spark):
    day = lambda i: F.timestamp_seconds(F.lit(1_704_067_200) + i * 86_400)
    df = spark.range(1, 301).select(F.lit("a").alias("symbol"), F.col("id").alias("seq"), day(F.col("id")).alias("bar_ts"), F.col("id").cast("double").alias("close"))
    events = spark.createDataFrame([("a", "early", 50), ("a", "late", 250), ("a", "never", 0)], "symbol string, event string, d int").select("symbol", "event", (day(F.col("d")) + F.expr("INTERVAL 5 HOURS")).alias("event_ts"))
    got = {(r["event"], r["size"], r["days_before"]): r for r in W.event_windows(df, events, (70, 120), (0, 10, 45), 60).collect()}
    want = {}
    for name, at in (("early", 50), ("late", 250)):
        for size in (70, 120):
            for d in (0, 10, 45):
                first, last = max(1, at - size), at - d
                if last - first >= 60:
                    want[(name, size, d)] = (first, last)
    assert {k: (r["first_seq"], r["last_seq"]) for k, r in got.items()} == want and len(want) == 5
    assert all(r["closes"] == [float(x) for x in range(want[k][0], want[k][1] + 1)] for k, r in got.items())
