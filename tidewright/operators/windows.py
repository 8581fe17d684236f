"""Bounded-frame, expanding and forward windows over bars (symbol, seq, open, high, low, close, volume ...).

Each function takes a DataFrame and returns it with columns added. Windows are keyed by symbol and ordered by seq, so all
of a function's columns share one shuffle and one sort.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-10


def by_seq():
    return Window.partitionBy("symbol").orderBy("seq")


def last_rows(n: int):
    return by_seq().rowsBetween(-(n - 1), 0)


def previous_rows(n: int):
    return by_seq().rowsBetween(-n, -1)


def next_rows(a: int, b: int):
    return by_seq().rowsBetween(a, b)


def so_far():
    return by_seq().rowsBetween(Window.unboundedPreceding, 0)


def full(x: Column, over, n: int, value: Column) -> Column:
    """value where the frame has n values, else null."""
    return F.when(F.count(x).over(over) >= n, value)


def returns(df: DataFrame) -> DataFrame:
    prev = F.lag("close").over(by_seq())
    return df.withColumns({"ret": F.coalesce(F.try_divide("close", prev) - 1, F.lit(0.0)), "log_ret": F.log(F.try_divide("close", prev))})


def gk_term() -> Column:
    hl, co = F.log(F.col("high") / F.greatest(F.col("low"), F.lit(EPS))), F.log(F.col("close") / F.greatest(F.col("open"), F.lit(EPS)))
    return 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co


def pk_term() -> Column:
    hl = F.log(F.try_divide("high", "low"))
    return hl * hl / (4 * math.log(2))


def volatility(df: DataFrame, n: int = 24) -> DataFrame:
    df = returns(df).withColumns({"gk": gk_term(), "pk": pk_term()})
    w = last_rows(n)
    rv = F.coalesce(F.stddev_samp("ret").over(w), F.lit(0.0))
    df = df.withColumns({"gk_vol": F.sqrt(F.greatest(F.lit(0.0), F.avg("gk").over(w))), "realized_vol": rv, "pk_vol": full(F.col("pk"), w, n, F.sqrt(F.avg("pk").over(w)))})
    ratio = F.when(F.col("realized_vol") > EPS, F.col("gk_vol") / F.col("realized_vol"))
    return df.withColumn("_ratio", ratio).withColumn("vol_ratio", F.coalesce(F.last("_ratio", ignorenulls=True).over(so_far()), F.lit(0.0))).drop("_ratio")


def zscore(df: DataFrame, column: str, n: int, name: str = "z", eps: float = EPS) -> DataFrame:
    w = last_rows(n)
    return df.withColumn(name, full(F.col(column), w, n, (F.col(column) - F.avg(column).over(w)) / (F.stddev_samp(column).over(w) + eps)))


def rolling_norm(df: DataFrame, column: str, n: int, name: str = "norm") -> DataFrame:
    w = last_rows(n)
    sd = F.stddev_samp(column).over(w)
    return df.withColumn(name, F.when((F.count(column).over(w) < 2) | (sd < EPS), 0.0).otherwise((F.col(column) - F.avg(column).over(w)) / sd))


def expanding_moments(df: DataFrame, column: str) -> DataFrame:
    """Mean, sample variance, adjusted skewness, and the adjusted kurtosis with its 3/(n-2) surplus; 0 while there are too few values."""
    w = so_far()
    n = F.count(column).over(w).cast("double")
    spread = F.var_pop(column).over(w)
    skew = F.when((n >= 3) & (spread >= 1e-14), F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(column).over(w)).otherwise(0.0)
    kurt = F.when((n >= 4) & (spread >= 1e-14), ((n * n - 1) * F.kurtosis(column).over(w) + 6 * (n - 1)) / ((n - 2) * (n - 3)) + 3 / (n - 2)).otherwise(0.0)
    return df.withColumns({"exp_mean": F.avg(column).over(w), "exp_var": F.coalesce(F.var_samp(column).over(w), F.lit(0.0)), "exp_skew": skew, "exp_kurt": kurt})


def expanding_z(df: DataFrame, column: str, name: str = "exp_z") -> DataFrame:
    w = so_far()
    sd = F.stddev_samp(column).over(w)
    return df.withColumn(name, F.when((F.count(column).over(w) < 2) | (sd < EPS), 0.0).otherwise((F.col(column) - F.avg(column).over(w)) / sd))


def fracdiff_weights(d: float, threshold: float) -> list[float]:
    out, k = [1.0], 1
    while True:
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < threshold:
            return out
        out.append(w)
        k += 1


def fracdiff(df: DataFrame, d: float = 0.4, threshold: float = 1e-5, strict: bool = False) -> DataFrame:
    """Fractionally differenced log close; a partial sum while warming up, or null with strict.

    The weights run back over more than a thousand rows, so rows go to blocks of that length and each block's sums are one
    convolution: a row serves its own block and, as history, the next, and no task holds more of a symbol than two blocks.
    """
    weights = np.array(fracdiff_weights(d, threshold))
    k = len(weights)
    block = F.floor((F.col("seq") - 1) / k)
    rows = df.select("symbol", "seq", F.log("close").alias("x"), F.explode(F.array(block, block + 1)).alias("block"))

    def convolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        x, seq = pdf["x"].to_numpy(float), pdf["seq"].to_numpy()
        total = np.convolve(np.nan_to_num(x), weights)[: len(x)]
        own = (seq - 1) // k == pdf["block"].to_numpy()
        total = np.where(np.isnan(x) | (strict & (seq < k)), np.nan, total)
        return pd.DataFrame({"symbol": pdf["symbol"][own], "seq": seq[own], "fracdiff": total[own]})

    found = rows.groupBy("symbol", "block").applyInPandas(convolve, "symbol string, seq long, fracdiff double")
    return df.join(found.withColumn("fracdiff", F.when(~F.isnan("fracdiff"), F.col("fracdiff"))), ["symbol", "seq"])


def momentum_z(df: DataFrame, n: int) -> DataFrame:
    w = last_rows(n)
    change = F.try_divide("close", F.lag("close", n).over(by_seq())) - 1
    return returns(df).withColumn(f"mom_z_{n}", change / (F.stddev_samp("ret").over(w) * math.sqrt(n) + EPS))


def percent_rank_last(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """100 times the share of the other values of the last n that are smaller; 50 for a single value."""
    values = F.collect_list(column).over(last_rows(n))
    below = F.size(F.filter(values, lambda x: x < F.col(column)))
    return df.withColumn("pct_rank", F.when(F.size(values) < 2, 50.0).otherwise(100.0 * below / (F.size(values) - 1)))


def rank_pct(df: DataFrame, column: str, n: int = 100, least: int = 20) -> DataFrame:
    """Average-rank percentile of the last value, and the distance of its mean percentile from the middle (toxicity)."""
    values = F.collect_list(column).over(last_rows(n))
    below, equal = F.size(F.filter(values, lambda x: x < F.col(column))), F.size(F.filter(values, lambda x: x == F.col(column)))
    rank = F.when(F.size(values) >= least, (below + (equal + 1) / 2) / F.size(values))
    middle = F.when(F.size(values) >= least, F.abs((below + below + equal) / (2 * F.size(values)) - 0.5) * 2)
    return df.withColumns({"rank_pct": F.coalesce(rank, F.lit(0.5)), "toxicity": middle})


def lagged_quantiles(df: DataFrame, column: str, n: int, least: int = 10) -> DataFrame:
    w = previous_rows(n)
    return df.withColumns({f"q{int(q * 100)}": F.when(F.count(column).over(w) >= least, F.percentile(column, F.lit(q)).over(w)) for q in (0.25, 0.95, 0.99)})


def autocorrelation(df: DataFrame, n: int = 20, lag: int = 1) -> DataFrame:
    df = returns(df).withColumn("_lag", F.lag("log_ret", lag).over(by_seq()))
    w = last_rows(n - 1)
    return df.withColumn("autocorr", full(F.col("_lag"), w, 3, F.corr("log_ret", "_lag").over(w))).drop("_lag")


def efficiency_ratio(df: DataFrame, n: int = 10) -> DataFrame:
    df = df.withColumn("_step", F.abs(F.col("close") - F.lag("close").over(by_seq())))
    path = F.sum("_step").over(last_rows(n))
    ratio = F.abs(F.col("close") - F.lag("close", n).over(by_seq())) / (path + EPS)
    return df.withColumn("eff_ratio", F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0))).drop("_step")


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    w = last_rows(n)
    low, high = F.min("low").over(w), F.max("high").over(w)
    raw = full(F.col("close"), w, n, F.when(high == low, 50.0).otherwise((F.col("close") - low) / (high - low) * 100))
    df = df.withColumn("_raw", raw)
    df = df.withColumn("stoch_k", full(F.col("_raw"), last_rows(smooth), smooth, F.avg("_raw").over(last_rows(smooth))))
    return df.withColumn("stoch_d", full(F.col("stoch_k"), last_rows(d), d, F.avg("stoch_k").over(last_rows(d)))).drop("_raw")


def donchian(df: DataFrame, entry: int = 20, leave: int = 10) -> DataFrame:
    out = {}
    for name, n in (("entry", entry), ("exit", leave)):
        w = previous_rows(n)
        out[f"{name}_upper"], out[f"{name}_lower"] = full(F.col("high"), w, n, F.max("high").over(w)), full(F.col("low"), w, n, F.min("low").over(w))
    return df.withColumns(out)


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    prev = F.lag("close").over(by_seq())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    df = df.withColumn("true_range", tr)
    return df.withColumn("atr", full(F.col("true_range"), last_rows(n), n, F.avg("true_range").over(last_rows(n))))


def averages(df: DataFrame) -> DataFrame:
    intensity = F.avg("duration").over(last_rows(20)) / (F.col("duration") + 1e-6)
    return df.withColumns({"sma20": full(F.col("close"), last_rows(20), 20, F.avg("close").over(last_rows(20))), "avg_volume": F.avg("volume").over(last_rows(100)), "avg_volume_lagged": F.avg("volume").over(previous_rows(100)), "intensity": intensity})


def regime_spells(df: DataFrame, regime: Column) -> DataFrame:
    """regime, spell (how many changes so far) and bars_in_regime (1 on the first bar)."""
    df = df.withColumn("regime", regime)
    changed = F.when(F.col("regime") == F.lag("regime").over(by_seq()), 0).otherwise(1)
    df = df.withColumn("_changed", changed).withColumn("spell", F.sum("_changed").over(so_far()))
    return df.withColumn("bars_in_regime", F.row_number().over(Window.partitionBy("symbol", "spell").orderBy("seq"))).drop("_changed")


def adverse_excursion(df: DataFrame, horizon: int = 10, window: int = 100, least: int = 10) -> DataFrame:
    """Largest move against a long and a short entry at the open within the horizon, and percentiles of those that were complete before the bar."""
    ahead = next_rows(1, horizon)
    whole = F.count("low").over(ahead) == horizon
    df = df.withColumns({"mae_long": F.when(whole, F.log(F.try_divide("open", F.min("low").over(ahead)))), "mae_short": F.when(whole, F.log(F.try_divide(F.max("high").over(ahead), "open")))})
    known = by_seq().rowsBetween(-window - horizon, -horizon - 1)
    return df.withColumn("mae_p95", F.when(F.count("mae_long").over(known) >= least, F.percentile("mae_long", F.lit(0.95)).over(known)))


def future_moves(df: DataFrame, horizon: int = 20, k: float = 1.0) -> DataFrame:
    df = atr(returns(df))
    ahead, moves = next_rows(1, horizon), next_rows(2, horizon)
    spread = F.max("high").over(ahead) - F.min("low").over(ahead)
    vol = F.stddev_samp("ret").over(last_rows(24))
    return df.withColumns({"wide_range": (spread >= math.sqrt(horizon) * k * F.col("atr")).cast("int"), "high_vol": (F.stddev_samp("ret").over(moves) >= vol).cast("int")})


def drawdown(df: DataFrame, column: str) -> DataFrame:
    df = df.withColumn("peak", F.max(column).over(so_far()))
    return df.withColumn("drawdown", F.try_divide(F.col("peak") - F.col(column), "peak"))


def histogram_entropy(df: DataFrame, n: int = 24, bins: int = 10) -> DataFrame:
    """Normalised entropy of the last n volatility-scaled returns over equal bins between their least and largest; 0 until there are n, or if they don't differ."""
    df = volatility(df, n).withColumn("_x", F.when(F.col("realized_vol") > 1e-8, F.col("ret") / F.col("realized_vol")).otherwise(F.col("ret")))
    values = F.collect_list("_x").over(last_rows(n))
    low, high = F.array_min(values), F.array_max(values)
    slot = F.transform(values, lambda x: F.least(F.floor(F.try_divide(x - low, high - low) * bins), F.lit(bins - 1)))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(slot, lambda s: s == b)) / F.lit(float(n)))
    h = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0)) / math.log(bins)
    return df.withColumn("entropy", F.when((F.size(values) < n) | (high - low < EPS), 0.0).otherwise(h)).drop("_x")
