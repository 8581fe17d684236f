"""Bars and features as one keyed stream: a symbol's state is its days' volumes, its open bar and what its features need.

The state lives in RocksDB beside the stream's checkpoint, so a stream that is started again with the same folder goes
on where it was. A state that can't be right is refused when it is loaded, before any row is made from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS, LATE_DAYS = 86_400_000, 45
RETURNS, CLOSES, HALFLIFE = 24, 20, 20
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

STATE = (
    "last_id long, late long, day long, days int, day_quote double, warm_sum double, ema double, threshold double, "
    "bar_no long, ticks long, start_ms long, end_ms long, open double, high double, low double, close double, volume double, dollar double, "
    "mean double, var double, n long, center double, m2 double, returns array<double>, closes array<double>"
)
NAMES = [f.split()[0] for f in STATE.split(", ")]
FRESH = dict.fromkeys(NAMES, 0) | dict.fromkeys(("day_quote", "warm_sum", "ema", "threshold", "open", "high", "low", "close", "volume", "dollar", "mean", "var", "center", "m2"), 0.0) | {"day": -1, "returns": [], "closes": []}
OUT = (
    "symbol string, bar_no long, start_time long, end_time long, open double, high double, low double, close double, volume double, dollar_value double, tick_count long, threshold double, "
    "log_ret double, ewm_z double, exp_z double, roll_vol double, momentum double, late_trades long"
)


class CorruptState(ValueError):
    """A stored state that no run of trades leads to."""


def validate(s: dict, warmup: int = 14) -> dict:
    """s, if it can be the state after some trades; CorruptState otherwise."""

    def refuse(what: str):
        raise CorruptState(f"{what}: {s}")

    for name in ("last_id", "late", "ticks", "bar_no", "n", "days"):
        if s[name] is None or s[name] < 0:
            refuse(f"{name} is negative or missing")
    for name in ("day_quote", "warm_sum", "ema", "threshold", "volume", "dollar", "var", "m2", "open", "high", "low", "close", "mean", "center"):
        if s[name] is None or not math.isfinite(s[name]):
            refuse(f"{name} is not finite")
    for name in ("day_quote", "warm_sum", "ema", "threshold", "volume", "dollar", "var", "m2"):
        if s[name] < 0:
            refuse(f"{name} is negative")
    if s["day"] < 0 and (s["days"] or s["ticks"] or s["day_quote"]):
        refuse("volumes without a day")
    if s["days"] < warmup and (s["ticks"] or s["n"] or s["threshold"]):
        refuse("bars before the end of warm-up")
    if s["ticks"] and not (0 < s["low"] <= min(s["open"], s["close"]) <= max(s["open"], s["close"]) <= s["high"] and s["start_ms"] <= s["end_ms"]):
        refuse("an open bar whose prices or times contradict each other")
    for name, most, least in (("returns", RETURNS, -math.inf), ("closes", CLOSES, 0.0)):
        if len(s[name]) > most or any(x is None or not math.isfinite(x) or x <= least for x in s[name]):
            refuse(f"{name} are too many or not finite")
    if len(s["closes"]) != min(s["n"], CLOSES) or len(s["returns"]) != min(max(0, s["n"] - 1), RETURNS):
        refuse("as many values are kept as there were not")
    return s


class Engine:
    """One symbol's trades in, its closed bars with features out. The state is a dict of NAMES."""

    def __init__(self, state: dict, bars_per_day: int, warmup: int, halflife: float):
        self.s, self.bars_per_day, self.warmup = state, bars_per_day, warmup
        self.alpha = 1 - math.exp(-math.log(2) / halflife)

    def _end_day(self) -> None:
        s = self.s
        s["days"] += 1
        if s["days"] <= self.warmup:
            s["warm_sum"] += s["day_quote"]
            s["ema"] = s["warm_sum"] / self.warmup if s["days"] == self.warmup else 0.0
        else:
            a = 2 / (self.warmup + 1)
            s["ema"] = a * s["day_quote"] + (1 - a) * s["ema"]
        s["day_quote"] = 0.0
        if s["days"] >= self.warmup:
            s["threshold"] = s["ema"] / self.bars_per_day

    def trade(self, trade_id: int, price: float, qty: float, quote: float, ts_ms: int) -> tuple | None:
        s = self.s
        if trade_id <= s["last_id"]:
            return None  # seen before
        day = ts_ms // DAY_MS
        if day < s["day"] - LATE_DAYS:
            s["late"] += 1
            return None
        s["last_id"] = trade_id
        if day > s["day"]:
            if s["day"] >= 0:
                self._end_day()
            s["day"] = day
        s["day_quote"] += quote
        if s["days"] < self.warmup:
            return None
        if not s["ticks"]:
            s |= {"start_ms": ts_ms, "end_ms": ts_ms, "open": price, "high": price, "low": price, "volume": 0.0, "dollar": 0.0}
        s |= {"start_ms": min(s["start_ms"], ts_ms), "end_ms": max(s["end_ms"], ts_ms), "high": max(s["high"], price), "low": min(s["low"], price), "close": price, "volume": s["volume"] + qty, "dollar": s["dollar"] + quote, "ticks": s["ticks"] + 1}
        return self._close() if s["dollar"] >= s["threshold"] - 1e-9 else None

    def _close(self) -> tuple:
        s = self.s
        x, a = s["close"], self.alpha
        step = math.log(x / s["closes"][-1]) if s["closes"] else None
        momentum = x / s["closes"][0] - 1 if len(s["closes"]) == CLOSES else None
        z = 0.0
        if s["n"]:
            delta = x - s["mean"]
            s["mean"] = a * x + (1 - a) * s["mean"]
            s["var"] = (1 - a) * s["var"] + (1 - a) * a * delta * delta
            if math.sqrt(s["var"]) >= 1e-10:
                z = (x - s["mean"]) / math.sqrt(s["var"])
        else:
            s["mean"] = x
        s["n"] += 1
        d = x - s["center"]
        s["center"] += d / s["n"]
        s["m2"] += d * (x - s["center"])
        sd = math.sqrt(s["m2"] / (s["n"] - 1)) if s["n"] > 1 else 0.0
        if step is not None:
            s["returns"] = [*s["returns"], step][-RETURNS:]
        s["closes"] = [*s["closes"], x][-CLOSES:]
        rs, vol = s["returns"], None
        if len(rs) > 1:
            mean = sum(rs) / len(rs)
            vol = math.sqrt(sum((r - mean) ** 2 for r in rs) / (len(rs) - 1))
        row = (s["bar_no"], s["start_ms"], s["end_ms"], s["open"], s["high"], s["low"], x, s["volume"], s["dollar"], s["ticks"], s["threshold"], step, 5 * math.tanh(z / 5), (x - s["center"]) / sd if sd >= 1e-10 else 0.0, vol, momentum, s["late"])
        s |= {"bar_no": s["bar_no"] + 1, "ticks": 0}
        return row


def in_order(trades: DataFrame) -> DataFrame:
    """A stream's trades, dealt out by symbol and sorted by trade_id within each micro-batch, so that a stateful function reads a symbol's trades part by part.

    Spark sorts a micro-batch's partition (on disk where memory doesn't hold it), but its check of streaming plans, which
    means orders over a whole stream, refuses any sort: the stream is to be started with UNCHECKED set to false.
    """
    return trades.repartition("symbol").sortWithinPartitions("symbol", "trade_id")


UNCHECKED = "spark.sql.streaming.unsupportedOperationCheck"


def ascending(parts: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """One symbol's rows of a micro-batch, at most `rows` at a time; ValueError if trade_id ever falls, as later rows would then pass for repeats."""
    last = None
    for whole in parts:
        for at in range(0, len(whole), rows):
            part = whole.iloc[at : at + rows]
            ids = part["trade_id"]
            if not ids.is_monotonic_increasing or last is not None and ids.iloc[0] < last:
                raise ValueError("a symbol's trades don't come in the order of trade_id")
            last = ids.iloc[-1]
            yield part


class BarFeatures(StatefulProcessor):
    def __init__(self, bars_per_day: int, warmup: int, halflife: float):
        self.parameters = bars_per_day, warmup, halflife

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("bars", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = dict(zip(NAMES, self.kept.get())) if self.kept.exists() else dict(FRESH, returns=[], closes=[])
        state |= {n: list(state[n]) for n in ("returns", "closes")}
        engine = Engine(validate(state, self.parameters[1]), *self.parameters)
        for part in ascending(rows):
            made = [r for t in zip(*(part[c].tolist() for c in ("trade_id", "price", "qty", "quote_qty", "ts_ms"))) if (r := engine.trade(*t)) is not None]
            if made:
                yield pd.DataFrame([(key[0], *r) for r in made], columns=[c.split()[0] for c in OUT.split(", ")])
        self.kept.update(tuple(engine.s[n] for n in NAMES))

    def close(self) -> None:
        pass


def bar_features(trades: DataFrame, bars_per_day: int = 8, warmup: int = 14, halflife: float = HALFLIFE) -> DataFrame:
    """A row for each closed dollar bar of a stream of trades (symbol, trade_id, price, qty, quote_qty, ts), as it closes, with its features.

    A bar closes when its quote volume reaches the exponential mean of the days before (which starts as the mean of the
    first `warmup` days) over bars_per_day. Features of the close: log_ret; ewm_z, clipped; exp_z over all bars; roll_vol,
    the deviation of 24 returns; momentum over 20 bars. Trades up to the last seen id are repeats; those more than 45 days
    before a symbol's current day are left out and counted (late_trades); others out of order go to the current bar and day.
    """
    rows = trades.select("symbol", "trade_id", "price", "qty", "quote_qty", F.unix_millis("ts").alias("ts_ms"))
    return in_order(rows).groupBy("symbol").transformWithStateInPandas(BarFeatures(bars_per_day, warmup, halflife), OUT, "Append", "None")
