"""Ordered recurrences, as blocked scans.

y[t] = b * y[t-1] + u[t] is affine, so blocks of rows are scanned on their own, each block's effect is one number, and
only those are carried along a key. No task sees more of a key than one block's rows, or one number for each block.
Recurrences that are not affine (a sum that is reset when it reaches a threshold; a filter whose gain depends on its
state) are ordered passes: rows dealt out by key and sorted, read batch by batch with a state of constant size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import state_machine
from .windows import EPS, by_seq, so_far

BLOCK = 512


def linear_scans(df: DataFrame, scans: list[tuple], block: int = BLOCK) -> DataFrame:
    """df with y[t] = b * y[t-1] + u[t] by symbol and seq (1, 2, 3 ... without gaps) for each (name, u, b, first) of scans; y of the first row is `first`, or u where that is None.

    Within a block y is a running sum of u scaled by powers of b; a block is short enough for those to stay in range. What
    blocks pass on is again such a recurrence: one ordered pass over each key's block ends, one row for a block, that
    holds one number for each scan. All scans share the blocks, their shuffle, and that pass.
    """
    names = [n for n, *_ in scans]
    sizes = [block if b == 0 or abs(b) >= 1 else max(2, min(block, int(200 / max(1e-9, -math.log(abs(b)))))) for _, _, b, _ in scans]
    n = min(sizes)
    at = ((F.col("seq") - 1) % n).cast("double")
    values = {f"_u{i}": (F.when(F.col("seq") == 1, first).otherwise(u) if first is not None else u) for i, (_, u, _, first) in enumerate(scans)}
    rows = df.withColumns({"_at": at, "_block": F.floor((F.col("seq") - 1) / n)} | values)
    w = Window.partitionBy("symbol", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    def local(i: int, b: float) -> Column:
        if b == 0:
            return F.col(f"_u{i}")
        base = F.lit(float(b))
        return F.pow(base, F.col("_at")) * F.sum(F.col(f"_u{i}") * F.pow(base, -F.col("_at"))).over(w)

    rows = rows.withColumns({f"_l{i}": local(i, b) for i, (_, _, b, _) in enumerate(scans)})
    ends = rows.groupBy("symbol", "_block").agg(*[F.max_by(f"_l{i}", "seq").alias(f"_e{i}") for i in range(len(scans))])
    steps = [float(b) ** n for _, _, b, _ in scans]
    columns = [f"_c{i}" for i in range(len(scans))]

    def carry(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None
        for pdf in pdfs:
            out = []
            for symbol, blk, *own in zip(*(pdf[c].tolist() for c in pdf.columns)):
                if held is None or symbol != key:
                    key, held = symbol, [0.0] * len(steps)
                out.append((symbol, blk, *held))
                held = [e + s * h for e, s, h in zip(own, steps, held)]
            yield pd.DataFrame(out, columns=["symbol", "_block", *columns])

    kind = df.schema["symbol"].dataType.simpleString()
    dealt = ends.repartition("symbol").sortWithinPartitions("symbol", "_block")
    carried = dealt.mapInPandas(carry, f"symbol {kind}, _block long, " + ", ".join(f"{c} double" for c in columns))
    done = rows.join(carried, ["symbol", "_block"], "left")
    found = {name: F.col(f"_l{i}") + (F.pow(F.lit(float(b)), F.col("_at") + 1) * F.coalesce(f"_c{i}", F.lit(0.0)) if b else 0.0) for i, (name, _, b, _) in enumerate(scans)}
    return done.withColumns(found).select(*[c for c in df.columns if c not in names], *names)


def linear_scan(df: DataFrame, u: Column, b: float, name: str, first: Column | None = None) -> DataFrame:
    """df with one recurrence, as linear_scans."""
    return linear_scans(df, [(name, u, b, first)])


def alpha_of(halflife: float | None = None, span: float | None = None, alpha: float | None = None) -> float:
    if alpha is not None:
        return alpha
    return 1 - math.exp(-math.log(2) / halflife) if halflife is not None else 2 / (span + 1)


def ewm_z(df: DataFrame, column: str, name: str = "ewm_z", **kind) -> DataFrame:
    """Exponential mean and variance (of the distance to the mean before), and the z-score by the new mean, clipped as 5 tanh(z / 5); primed after max(10, 2 / alpha) rows."""
    a = alpha_of(**kind)
    df = linear_scan(df, a * F.col(column), 1 - a, "ewm_mean", F.col(column))
    delta = F.col(column) - F.lag("ewm_mean").over(by_seq())
    df = df.withColumn("_d2", (1 - a) * a * delta * delta)
    df = linear_scan(df, F.col("_d2"), 1 - a, "ewm_var", F.lit(0.0)).drop("_d2")
    sd = F.sqrt(F.greatest(F.col("ewm_var"), F.lit(0.0)))
    z = F.when((F.col("seq") == 1) | (sd < 1e-10), 0.0).otherwise((F.col(column) - F.col("ewm_mean")) / sd)
    return df.withColumn(name, 5 * F.tanh(z / 5)).withColumn("is_primed", F.col("seq") >= max(10, int(2 / a)))


def ewm_adjusted(df: DataFrame, column: str, halflife: float) -> DataFrame:
    """Adjusted exponential mean, and standard deviation corrected for bias, as weighted by (1 - alpha)^age."""
    b = 1 - alpha_of(halflife=halflife)
    x = F.col(column)
    df = linear_scans(df, [("_w", F.lit(1.0), b, None), ("_w2", F.lit(1.0), b * b, None), ("_wx", x, b, None), ("_wxx", x * x, b, None)])
    mean = F.col("_wx") / F.col("_w")
    biased = F.greatest(F.col("_wxx") / F.col("_w") - mean * mean, F.lit(0.0))
    spare = F.col("_w") * F.col("_w") - F.col("_w2")
    return df.withColumns({"ewma": mean, "ewm_std": F.when(spare > 1e-12, F.sqrt(biased * F.col("_w") * F.col("_w") / spare))}).drop("_w", "_w2", "_wx", "_wxx")


def wilder_rsi(df: DataFrame, column: str, n: int, name: str = "rsi") -> DataFrame:
    """RSI with Wilder's averages, started by the first gain and loss; 50 where nothing moved, 100 where nothing was lost."""
    step = F.col(column) - F.lag(column).over(by_seq())
    df = df.withColumns({"_g": F.greatest(F.coalesce(step, F.lit(0.0)), F.lit(0.0)), "_l": F.greatest(-F.coalesce(step, F.lit(0.0)), F.lit(0.0))})
    df = linear_scans(df, [("_up", F.col("_g") / n, 1 - 1 / n, F.col("_g")), ("_down", F.col("_l") / n, 1 - 1 / n, F.col("_l"))])
    rsi = F.when((F.col("_up") < EPS) & (F.col("_down") < EPS), 50.0).when(F.col("_down") < EPS, 100.0).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down")))
    return df.withColumn(name, rsi).drop("_g", "_l", "_up", "_down")


def daily_threshold(trades: DataFrame, bars_per_day: int, warmup: int = 14) -> DataFrame:
    """Each symbol's and day's threshold: the exponential mean of the days before, divided by bars_per_day; null during warm-up. The mean starts as that of the first `warmup` days."""
    daily = trades.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("quote_qty").alias("day_quote"))
    daily = daily.withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("day")))
    start = F.avg(F.when(F.col("seq") <= warmup, F.col("day_quote"))).over(Window.partitionBy("symbol"))
    daily = daily.withColumn("_start", start)
    a = 2 / (warmup + 1)
    u = F.when(F.col("seq") < warmup, F.lit(0.0)).when(F.col("seq") == warmup, F.col("_start")).otherwise(a * F.col("day_quote"))
    scanned = linear_scan(daily, u, 1 - a, "ema", F.when(F.lit(warmup == 1), F.col("_start")).otherwise(0.0)).drop("_start")
    before = F.lag("ema").over(by_seq())
    return scanned.withColumn("threshold", F.when(F.col("seq") > warmup, before / bars_per_day)).withColumnRenamed("seq", "day_no")


def dollar_bar_ids(trades: DataFrame, thresholds: DataFrame, exact: bool = True) -> DataFrame:
    """Trades (after warm-up) with bar_id. A bar takes trades until their quote volume reaches the threshold of the day of its last trade; the surplus is dropped, and an open bar lives on over midnight.

    exact: bars are found by hops along running sums, in one ordered pass that carries the open bar's sum. Otherwise bar ids are multiples
    of the threshold within the day's running sum, which needs no keyed function.
    """
    rows = trades.withColumn("day", F.to_date("ts")).join(thresholds.where("threshold IS NOT NULL").select("symbol", "day", "threshold"), ["symbol", "day"])
    if not exact:
        w = Window.partitionBy("symbol", "day").orderBy("trade_id").rowsBetween(Window.unboundedPreceding, -1)
        number = F.floor(F.coalesce(F.sum("quote_qty").over(w), F.lit(0.0)) / F.col("threshold"))
        return rows.withColumn("bar_id", F.datediff("day", F.lit("1970-01-01")) * 100_000 + number)

    def hop(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bar, open_ = None, 0, 0.0  # of the symbol before: the next bar's number and what it holds
        for pdf in pdfs:
            symbols, quotes, limits = pdf["symbol"].to_numpy(), pdf["quote_qty"].to_numpy(), pdf["threshold"].to_numpy()
            out = np.zeros(len(pdf), np.int64)
            changes = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
            for a, z in zip([0, *changes], [*changes, len(pdf)]):
                if symbols[a] != key:
                    key, bar, open_ = symbols[a], 0, 0.0
                total, limit = open_ + np.cumsum(quotes[a:z]), limits[a:z]
                days = np.flatnonzero(np.append(True, limit[1:] != limit[:-1]))
                start, taken = 0, 0.0
                for first, end in zip(days, [*days[1:], z - a]):
                    at = first
                    while at < end:
                        # the first trade at which the bar's sum reaches this day's threshold
                        stop = at + int(np.searchsorted(total[at:end], taken + limit[first] - 1e-9, "left"))
                        if stop >= end:
                            break
                        out[a + start : a + stop + 1] = bar
                        bar, start, taken, at = bar + 1, stop + 1, total[stop], stop + 1
                out[a + start : z] = bar
                open_ = total[-1] - taken
            yield pdf.assign(bar_id=out)

    schema = T.StructType([*rows.schema.fields, T.StructField("bar_id", T.LongType())])
    return rows.repartition("symbol").sortWithinPartitions("symbol", "trade_id").mapInPandas(hop, schema)


def aggregate_bars(trades: DataFrame) -> DataFrame:
    """Bars from trades with bar_id: first, extreme (with their first times) and last price, sums, and aggressor volumes."""
    buy = F.when(F.col("is_aggressor_buy"), F.col("quote_qty")).otherwise(0.0)
    out = trades.groupBy("symbol", "bar_id").agg(
        F.min("ts_ms").alias("start_time"),
        F.max("ts_ms").alias("end_time"),
        F.min_by("price", "trade_id").alias("open"),
        F.max("price").alias("high"),
        F.min_by("ts_ms", F.struct((-F.col("price")).alias("p"), "trade_id")).alias("high_time"),
        F.min("price").alias("low"),
        F.min_by("ts_ms", F.struct("price", "trade_id")).alias("low_time"),
        F.max_by("price", "trade_id").alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("quote_qty").alias("dollar_value"),
        F.count("*").alias("tick_count"),
        F.sum(buy).alias("buy_dollar_vol"),
    )
    sell = F.col("dollar_value") - F.col("buy_dollar_vol")
    return out.withColumns({"duration": F.greatest((F.col("end_time") - F.col("start_time")) / 1000.0, F.lit(0.001)), "sell_dollar_vol": sell, "net_imbalance": F.col("buy_dollar_vol") - sell})


def tib_bar_ids(trades: DataFrame, expected_ticks: float, p_buy: float) -> DataFrame:
    """Trades with tick (the sign of the last price change, 1 before any) and bar_id of tick-imbalance bars: a bar closes where the absolute sum of its ticks reaches expected_ticks * |2 p_buy - 1|.

    One ordered pass carries the last price and sign, the open bar's sum and its number.
    """
    limit = expected_ticks * abs(2 * p_buy - 1)

    def hop(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, price, sign, total, bar = None, None, 1, 0, 0
        for pdf in pdfs:
            ticks, ids = [], []
            for symbol, p in zip(pdf["symbol"].tolist(), pdf["price"].tolist()):
                if symbol != key:
                    key, price, sign, total, bar = symbol, p, 1, 0, 0
                if p != price:
                    sign, price = 1 if p > price else -1, p
                ticks.append(sign)
                ids.append(bar)
                total += sign
                if abs(total) >= limit:
                    total, bar = 0, bar + 1
            yield pdf.assign(tick=np.array(ticks, np.int32), bar_id=np.array(ids, np.int64))

    schema = T.StructType([*trades.schema.fields, T.StructField("tick", T.IntegerType()), T.StructField("bar_id", T.LongType())])
    return trades.repartition("symbol").sortWithinPartitions("symbol", "trade_id").mapInPandas(hop, schema)


def switch(df: DataFrame, enter_long: Column, enter_short: Column, name: str = "position") -> DataFrame:
    """Position 1 or -1 from the bar of such a signal until one for the other side; 0 before any."""
    signal = F.when(enter_long, 1).when(enter_short, -1)
    return df.withColumn("_signal", signal).withColumn(name, F.coalesce(F.last("_signal", ignorenulls=True).over(so_far()), F.lit(0))).drop("_signal")


def latch(df: DataFrame, enter_long: Column, enter_short: Column, exit_long: Column, exit_short: Column, name: str = "position", policy: str = "a") -> DataFrame:
    """Position -1, 0 or 1. From flat, an entry is taken; what a held position does depends on the policy:

    a: an exit flattens, and nothing is entered on its bar. b: an exit flattens, or turns if the other side enters on its
    bar. c: exits don't count, an entry of the other side turns. d: as a, and an entry of the other side turns where no
    exit fired. e: an exit turns, and so does an entry of the other side. f: an exit flattens and any entry of its bar is
    taken; an entry of the other side turns. bd: b and d together.

    Each row maps the three states to states; state_machine composes such maps block by block.
    """

    def state(held: int) -> Column:
        fresh = F.when(enter_long, F.lit(1)).when(enter_short, F.lit(-1)).otherwise(F.lit(0))
        if not held:
            return fresh
        leave, other = (exit_long, enter_short) if held > 0 else (exit_short, enter_long)
        stay = F.lit(held) if policy in ("a", "b") else F.when(other, F.lit(-held)).otherwise(F.lit(held))
        if policy == "c":
            return stay
        gone = {"e": F.lit(-held), "f": fresh, "a": F.lit(0), "d": F.lit(0)}.get(policy, F.when(other, F.lit(-held)).otherwise(F.lit(0)))
        return F.when(leave, gone).otherwise(stay)

    # states 0, 1, 2 stand for -1, 0, 1
    return state_machine(df, [state(s) + 1 for s in (-1, 0, 1)], name, start=1).withColumn(name, F.col(name) - 1)


def kalman(df: DataFrame, q: float = 1e-4, window: int = 20) -> DataFrame:
    """Trend and velocity of the log typical price by a two-state filter; measurement noise is the rolling variance of log close. A null price only predicts.

    Gains depend on the state, so each symbol is one sequence; it is read in order, one Arrow batch after the other.
    """
    w = by_seq().rowsBetween(-(window - 1), 0)
    rows = df.select("symbol", "seq", F.log((F.col("high") + F.col("low") + F.col("close")) / 3).alias("y"), F.greatest(F.coalesce(F.var_samp(F.log("close")).over(w), F.lit(1e-4)), F.lit(1e-8)).alias("r"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, x, v, p00, p01, p11 = None, 0.0, 0.0, 1.0, 0.0, 1.0
        for pdf in pdfs:
            out = []
            for symbol, seq, y, r in zip(pdf["symbol"], pdf["seq"], pdf["y"], pdf["r"]):
                if symbol != key:
                    key, x, v, p00, p01, p11 = symbol, (y if y == y else 0.0), 0.0, 1.0, 0.0, 1.0
                x, p00, p01, p11 = x + v, p00 + 2 * p01 + p11 + q / 4, p01 + p11 + q / 2, p11 + q
                predicted = x
                if y == y:
                    s = p00 + r
                    k0, k1, e = p00 / s, p01 / s, y - x
                    x, v = x + k0 * e, v + k1 * e
                    p00, p01, p11 = (1 - k0) * p00, (1 - k0) * p01, p11 - k1 * p01
                out.append((symbol, seq, x, predicted, v, p00))
            yield pd.DataFrame(out, columns=["symbol", "seq", "kf_trend", "kf_trend_pred", "kf_velocity", "kf_uncertainty"])

    ordered = rows.repartition("symbol").sortWithinPartitions("symbol", "seq")
    return df.join(ordered.mapInPandas(run, "symbol string, seq long, kf_trend double, kf_trend_pred double, kf_velocity double, kf_uncertainty double"), ["symbol", "seq"])
