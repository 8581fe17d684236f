"""Signals derived from bars: modified Connors RSI, residual spread, stress, sign reversals of a z-score, momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recurrences import linear_scans
from .windows import EPS, by_seq, full, last_rows, percent_rank_last, rank_pct


def connors(df: DataFrame, n: int = 3, rank: int = 100) -> DataFrame:
    """Mean of the returns' RSI by Wilder's averages over n and the return's percent rank among the last `rank`; 0 for the first bar, which has no return."""
    before = F.lag("close").over(by_seq())
    moved = df.withColumn("_ret", F.when(before > EPS, F.try_divide("close", before) - 1).otherwise(0.0))
    later = moved.where("seq > 1").withColumns({"seq": F.col("seq") - 1, "_g": F.greatest(F.col("_ret"), F.lit(0.0)), "_l": F.greatest(-F.col("_ret"), F.lit(0.0))})
    later = linear_scans(later, [("_up", F.col("_g") / n, 1 - 1 / n, F.col("_g")), ("_down", F.col("_l") / n, 1 - 1 / n, F.col("_l"))])
    later = percent_rank_last(later, "_ret", rank)
    rsi = F.when((F.col("_up") < EPS) & (F.col("_down") < EPS), 50.0).when(F.col("_down") < EPS, 100.0).otherwise(100 - 100 / (1 + F.col("_up") / F.col("_down")))
    later = later.withColumns({"connors": (rsi + F.col("pct_rank")) / 2, "seq": F.col("seq") + 1})
    return moved.where("seq = 1").withColumn("connors", F.lit(0.0)).select(*df.columns, "connors").unionByName(later.select(*df.columns, "connors"))


def residual_sd(df: DataFrame, trend: str, n: int = 180, least: int = 30, floor: float = 0.01) -> DataFrame:
    """Spread of ln(close / trend) over the last n bars; with fewer than `least`, that of the whole series, or `floor` where it has none."""
    positive = (F.col("close") > 0) & (F.col(trend) > 0)
    df = df.withColumn("resid", F.when(positive, F.log("close") - F.log(trend)))
    whole = F.stddev_pop("resid").over(Window.partitionBy("symbol"))
    last = full(F.col("resid"), last_rows(n), least, F.stddev_samp("resid").over(last_rows(n)))
    return df.withColumn("resid_sd", F.coalesce(last, F.when(whole >= EPS, whole), F.lit(floor)))


def stress(df: DataFrame, forecast: str, variance: str, n: int = 20, least: int = 5) -> DataFrame:
    """Mean square of the last n one-step errors, each in standard deviations; null with fewer than `least`."""
    error = F.try_divide(F.col("close") - F.lag(forecast).over(by_seq()), F.sqrt(F.lag(variance).over(by_seq())))
    df = df.withColumn("_e2", error * error)
    return df.withColumn("stress", full(F.col("_e2"), last_rows(n), least, F.avg("_e2").over(last_rows(n)))).drop("_e2")


def reversals(df: DataFrame, z: str, future: Column) -> DataFrame:
    """Bars where z changes its sign, by how far it jumps: how often the later return goes the new way, and how often it goes the other way by over 1 %."""
    before = F.lag(z).over(by_seq())
    turned = df.select("symbol", F.col(z).alias("z"), before.alias("before"), future.alias("f")).where("sign(z) <> sign(before) and f is not null")
    jump, won = F.abs(F.col("z") - F.col("before")), F.sign("z") * F.col("f")
    intensity = F.when(jump < 1, "weak").when(jump < 2, "medium").otherwise("strong")
    share = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    return turned.groupBy("symbol", intensity.alias("intensity")).agg(F.count("*").alias("n"), share(won > 0).alias("accuracy"), share(won < -0.01).alias("fake_outs"))


def momentum_signal(speed: Column, acceleration: Column | None = None, trending: Column | None = None, least: float = 0.3) -> Column:
    """1 and -1 where speed is beyond `least`, and, where asked for, acceleration has its sign and the market trends; it holds no position."""
    up, down = speed > least, speed < -least
    if acceleration is not None:
        up, down = up & (acceleration > 0), down & (acceleration < 0)
    if trending is not None:
        up, down = up & trending, down & trending
    return F.when(up, 1).when(down, -1).otherwise(0)


def impulse_features(df: DataFrame, rsi: int = 14, n: int = 20, rank: int = 100, threshold: float = 0.4, cap: float = 0.95) -> DataFrame:
    """df with kf_rsi (of the trend, by exponential means of span `rsi`), z_score (the close less the trend's forecast over its deviation of n rows, the symbol's own where there are fewer than five, within 5), efficiency (the rank of |velocity| over uncertainty among `rank` rows, 0.5 with fewer than 20) and trending (efficiency over the threshold and uncertainty below its `cap` quantile of those rows). df: close, kf_trend, kf_trend_pred, kf_velocity, kf_uncertainty."""
    step = F.coalesce(F.col("kf_trend") - F.lag("kf_trend").over(by_seq()), F.lit(0.0))
    df = df.withColumns({"_g": F.greatest(step, F.lit(0.0)), "_l": F.greatest(-step, F.lit(0.0)), "_d": F.col("close") - F.col("kf_trend_pred"), "_e": F.abs("kf_velocity") / (F.col("kf_uncertainty") + 1e-10)})
    a = 2 / (rsi + 1)
    df = linear_scans(df, [("_up", a * F.col("_g"), 1 - a, F.col("_g")), ("_down", a * F.col("_l"), 1 - a, F.col("_l"))])
    whole = df.groupBy("symbol").agg(F.stddev_samp("_d").alias("_sd"), F.max("kf_uncertainty").alias("_most"))
    w, w100 = last_rows(n), last_rows(rank)
    sd = F.coalesce(F.when(F.count("_d").over(w) >= 5, F.stddev_samp("_d").over(w)), F.col("_sd"))
    df = percent_ranks(df.join(whole, "symbol"), "_e", rank, 20, "efficiency")
    top = F.coalesce(F.when(F.count("kf_uncertainty").over(w100) >= 20, F.percentile("kf_uncertainty", F.lit(cap)).over(w100)), F.col("_most"))
    z = F.col("_d") / F.when(sd == 0, 1e-10).otherwise(sd)
    df = df.withColumns({"kf_rsi": 100 - 100 / (1 + F.col("_up") / (F.col("_down") + 1e-10)), "z_score": F.least(F.lit(5.0), F.greatest(F.lit(-5.0), z)), "trending": (F.col("efficiency") > threshold) & (F.col("kf_uncertainty") < top)})
    return df.drop("_g", "_l", "_d", "_e", "_up", "_down", "_sd", "_most")


def percent_ranks(df: DataFrame, column: str, n: int, least: int, name: str) -> DataFrame:
    """df with the rank of a column's value among the last n, ties sharing theirs, as a share; 0.5 with fewer than `least`."""
    return rank_pct(df, column, n, least).withColumnRenamed("rank_pct", name).drop("toxicity")


def hurst_switch(df: DataFrame, momentum: str, z: str, rsi: str, hurst: str, average: str, volatility: str, entry: float = 1.0, fade: float = 2.0, calm: float = 0.95) -> DataFrame:
    """df with momentum_signal, revert_signal and signal: momentum's where the Hurst exponent says trending (over 0.55), the reverting one's where it says so (below 0.45), 0 between, without one, or where volatility is over its symbol's `calm` quantile.

    Momentum goes with its z of 50 rows beyond `entry` on the average's side while the RSI has room (80, 20); reverting
    goes against a z beyond `fade` with an RSI below 35 or over 65.
    """
    w = last_rows(50)
    mz = F.when(F.count(momentum).over(w) >= 50, (F.col(momentum) - F.avg(momentum).over(w)) / (F.stddev_samp(momentum).over(w) + 1e-10))
    r, x = F.col(rsi), F.col(z)
    df = df.withColumn("_mz", mz)
    go = F.when((F.col("_mz") > entry) & (F.col("close") > F.col(average)) & (r < 80), 1).when((F.col("_mz") < -entry) & (F.col("close") < F.col(average)) & (r > 20), -1).otherwise(0)
    back = F.when((x < -fade) & (r < 35), 1).when((x > fade) & (r > 65), -1).otherwise(0)
    bounds = df.groupBy("symbol").agg(F.percentile(volatility, F.lit(calm)).alias("_wild"))
    df = df.join(bounds, "symbol").withColumns({"momentum_signal": go, "revert_signal": back})
    chosen = F.when(F.col(volatility) > F.col("_wild"), 0).when(F.col(hurst) > 0.55, F.col("momentum_signal")).when(F.col(hurst) < 0.45, F.col("revert_signal")).otherwise(0)
    return df.withColumn("signal", chosen).drop("_mz", "_wild")
