"""Streaming bars and features: restarts, repeats, late trades, corrupt states."""

import math

import pytest
from pyspark.sql import functions as F

from tidewright.operators import recurrences as R
from tidewright.operators import windows as W
from tidewright.sources import market as M
from tidewright.streaming import features as V
from tidewright.streaming import trades as S

FEATURES = ("close", "volume", "dollar_value", "log_ret", "ewm_z", "exp_z", "roll_vol", "momentum")


@pytest.fixture(scope="module")
def batch(spark, sf):
    """The closed bars and their features from windows over the whole table."""
    trades = M.trades(spark, sf)
    thresholds = R.daily_threshold(trades, 8)
    bars = R.aggregate_bars(R.dollar_bar_ids(trades, thresholds))
    closed = bars.withColumn("day", F.to_date(F.timestamp_millis("end_time"))).join(thresholds.select("symbol", "day", "threshold"), ["symbol", "day"]).where("dollar_value >= threshold - 1e-9")
    rows = closed.withColumn("seq", F.row_number().over(W.Window.partitionBy("symbol").orderBy("bar_id")).cast("long"))
    rows = R.ewm_z(W.expanding_z(rows, "close"), "close", halflife=V.HALFLIFE)
    rows = rows.withColumn("log_ret", F.log(F.col("close") / F.lag("close").over(W.by_seq())))
    rows = rows.withColumns({"roll_vol": F.stddev_samp("log_ret").over(W.last_rows(24)), "momentum": F.col("close") / F.lag("close", 20).over(W.by_seq()) - 1})
    return {(r["symbol"], r["seq"] - 1): [r[c] for c in FEATURES] for r in rows.collect()}


def near(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) <= 1e-8 * max(1, abs(a))


def as_dict(rows):
    out = {(r["symbol"], r["bar_no"]): [r[c] for c in FEATURES] for r in rows.collect()}
    return out


def equal(a, b):
    assert a.keys() == b.keys() and len(a) > 50
    for k in a:
        assert all(map(near, a[k], b[k])), (k, a[k], b[k])


def test_one_run_equals_windows(spark, sf, batch):
    equal(as_dict(S.drained(V.bar_features(S.read_events(spark, f"{sf}/events.parquet")))), batch)


def test_restart_in_the_middle(spark, sf, batch, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    cut = events.approxQuantile("event_id", [0.6], 0.0)[0]
    source, folder = f"{tmp_path}/in", f"file://{tmp_path}/run"
    events.where(F.col("event_id") <= cut).coalesce(1).write.mode("append").parquet(source)
    first = as_dict(S.drained(V.bar_features(S.read_events(spark, source)), folder=folder))
    assert 0 < len(first) < len(batch)
    # the second half comes with repeats of the first
    events.where(F.col("event_id") > cut - 50).coalesce(1).write.mode("append").parquet(source)
    equal(as_dict(S.drained(V.bar_features(S.read_events(spark, source)), folder=folder)), batch)
    again = as_dict(S.drained(V.bar_features(S.read_events(spark, source)), folder=folder))
    equal(again, batch)  # nothing new, nothing twice


def engine(trades, state=None):
    e = V.Engine(dict(V.FRESH, returns=[], closes=[]) if state is None else state, 2, 2, 5)
    return e, [r for t in trades if (r := e.trade(*t)) is not None]


def some_trades(n=400):
    return [(i + 1, 10 + math.sin(i), 1.0, 10 + math.sin(i), 1_000 + i * 3_600_000) for i in range(n)]


def test_state_goes_on_anywhere():
    whole = engine(some_trades())[1]
    for cut in (0, 1, 47, 48, 49, 200, 399):
        e, first = engine(some_trades()[:cut])
        kept = V.validate({n: e.s[n] for n in V.NAMES}, 2)
        assert first + engine(some_trades()[cut:], kept)[1] == whole
    assert len(whole) > 10


def test_late_trades_are_counted():
    e, _ = engine(some_trades(2_000))
    before = dict(e.s)
    assert e.trade(99_999, 10.0, 1.0, 10.0, 5_000) is None and e.s == before | {"late": 1}
    # out of order by less than that goes to the current bar
    e.trade(99_999, 10.0, 1.0, 10.0, e.s["day"] * V.DAY_MS - 5)
    assert e.s["last_id"] == 99_999


@pytest.mark.parametrize(
    "broken",
    [{"last_id": -1}, {"days": -1}, {"day_quote": -0.5}, {"ema": math.nan}, {"threshold": math.inf}, {"threshold": -1.0}, {"dollar": math.nan}, {"volume": -1.0}, {"ticks": -3}, {"m2": -1e-3}, {"high": 1.0}, {"end_ms": 0},
     {"returns": [math.nan]}, {"closes": [1.0] * 21}, {"closes": []}, {"days": 1}, {"day": -1}, {"late": None}],
)
def test_corrupt_states_are_refused(broken):
    e, _ = engine(some_trades(201))
    good = {n: e.s[n] for n in V.NAMES}
    assert good["ticks"] and V.validate(good, 2) is good
    with pytest.raises(V.CorruptState):
        V.validate(good | broken, 2)
