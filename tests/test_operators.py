import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.operators import labels as L
from tidewright.operators import recurrences as R
from tidewright.operators import rules as U
from tidewright.sources import market as M
from tidewright.streaming import trades as S


def series(spark, n, keys=("a", "b"), seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(k, i + 1, rng.gauss(0, 1)) for k in keys for i in range(n)], "symbol string, seq long, x double").repartition(3)


def test_linear_scan_equals_a_loop_over_several_blocks(spark):
    df = series(spark, 3 * R.BLOCK + 17)
    got = {(r["symbol"], r["seq"]): (r["x"], r["y"]) for r in R.linear_scan(df, F.col("x"), 0.97, "y").collect()}
    for k in "ab":
        y = 0.0
        for i in range(1, 3 * R.BLOCK + 18):
            x, found = got[k, i]
            y = 0.97 * y + x
            assert abs(found - y) < 1e-9


def test_latch_equals_a_loop(spark):
    df = series(spark, 2 * R.BLOCK + 5)
    x = F.col("x")
    got = {(r["symbol"], r["seq"]): r for r in R.latch(df, x > 1, x < -1, x < 0, x > 0).collect()}
    for k in "ab":
        held = 0
        for i in range(1, 2 * R.BLOCK + 6):
            v = got[k, i]["x"]
            held = (0 if v < 0 else 1) if held == 1 else (0 if v > 0 else -1) if held == -1 else 1 if v > 1 else -1 if v < -1 else 0
            assert got[k, i]["position"] == held


def test_forward_pairs_meet_each_bar_once(spark):
    df = series(spark, 100)
    pairs = L.forward_pairs(df.select("symbol", "seq"), df.select("symbol", "seq"), 7).groupBy("symbol", "seq").count().collect()
    assert {(r["symbol"], r["seq"]): r["count"] for r in pairs} == {(k, i): min(7, 100 - i) for k in "ab" for i in range(1, 100)}


def test_chain_takes_no_overlapping_trades(spark):
    rows = [("a", s, s + n) for s, n in ((1, 5), (3, 2), (6, 1), (7, 3), (9, 1), (12, 4))]
    got = [(r["entry_seq"], r["exit_seq"]) for r in L.chain(spark.createDataFrame(rows, "symbol string, entry_seq long, exit_seq long")).orderBy("entry_seq").collect()]
    assert got == [(1, 6), (7, 10), (12, 16)]


def test_normal_cdf(spark):
    xs = [-3.0, -0.5, 0.0, 1.0, 2.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", U.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * (1 + math.erf(r["x"] / math.sqrt(2)))) < 2e-7 for r in got)


CSV = "id,price,qty,quote_qty,time,is_buyer_maker,is_best_match\n1, 100.5 ,2,201,1704067200000,true,false\n2,-1,2,2,1704067200001,false,true\nx,1,1,1,1,true,true\n3,100,1,100,1704067200002,False\n"


def test_trade_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("t.csv", CSV)
        z.writestr("notes.txt", "no trades")
    for df in (M.read_trades_csv(spark, str(tmp_path / "t.csv"), "s"), M.read_trades_zip(spark, str(tmp_path / "t.zip"), "s")):
        assert [(r["trade_id"], r["price"], r["is_best_match"]) for r in df.orderBy("trade_id").collect()] == [(1, 100.5, False), (2, -1.0, True), (3, 100.0, True)]
        ok, bad = M.split_valid(df)
        assert ok.count() == 2 and bad.first()["reason"] == "price"


def test_months_are_replaced_one_by_one(spark, sf, tmp_path):
    b = M.bars(spark, sf)
    path = str(tmp_path / "bars")
    M.write_by_month(b, path)
    M.write_by_month(b.where("symbol = 'click'"), path)
    assert M.read_months(spark, path, "2000-01", "2100-01").count() == b.count()


def test_stream_bars_equal_a_loop(spark, sf):
    got = S.drained(S.dollar_bars(S.read_events(spark, f"{sf}/events.parquet"), 20_000.0))
    expected = 0
    totals = {}
    for t in M.trades(spark, sf).orderBy("trade_id").collect():
        totals[t["symbol"]] = totals.get(t["symbol"], 0.0) + t["quote_qty"]
        if totals[t["symbol"]] >= 20_000:
            totals[t["symbol"]] = 0.0
            expected += 1
    assert got.count() == expected > 0


@pytest.mark.parametrize("name", sorted(U.RULES))
def test_rules_give_predicates(name):
    assert set(U.RULES[name](0.1) if name == "scalp" else U.RULES[name]()) == {"enter_long", "enter_short", "exit_long", "exit_short"}


def test_nan_to_num_keeps_nulls(spark):
    from tidewright.functions.cleaning import nan_to_num

    df = spark.createDataFrame([(1, 2.5), (2, float("nan")), (3, float("-inf")), (4, None)], "k int, x double")
    got = {r["k"]: r["x"] for r in df.select("k", nan_to_num("x").alias("x")).collect()}
    assert got == {1: 2.5, 2: 0.0, 3: 0.0, 4: None}
