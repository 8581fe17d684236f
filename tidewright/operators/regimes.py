"""Regimes, spells, hysteresis, information measures and samples."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import by_seq, last_rows, so_far


def hysteresis(df: DataFrame, enter: Column, leave: Column, name: str = "state") -> DataFrame:
    """1 from a row where `enter` holds until one where `leave` does: the last of the two kinds of event decides, so there is no loop."""
    event = F.when(enter, 1).when(leave, 0)
    return df.withColumn("_e", event).withColumn(name, F.coalesce(F.last("_e", ignorenulls=True).over(so_far()), F.lit(0))).drop("_e")


def spells(df: DataFrame, flag: Column) -> DataFrame:
    """first_seq, last_seq, bars and ret (from its first close to its last) of each spell of rows where flag holds."""
    rows = df.withColumn("_f", F.coalesce(flag.cast("int"), F.lit(0)))
    rows = rows.withColumn("_c", F.when(F.col("_f") == F.lag("_f").over(by_seq()), 0).otherwise(1)).withColumn("_s", F.sum("_c").over(so_far()))
    out = rows.where("_f = 1").groupBy("symbol", "_s").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("bars"), (F.max_by("close", "seq") / F.min_by("close", "seq") - 1).alias("ret"))
    return out.drop("_s")


def transitions(df: DataFrame, state: str) -> DataFrame:
    """from_state, to_state, n and p (the share among the symbol's moves from that state)."""
    moves = df.withColumn("from_state", F.lag(state).over(by_seq())).where("from_state IS NOT NULL").groupBy("symbol", "from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n"))
    return moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol", "from_state")))


def mutual_information(df: DataFrame, feature: str, label: str, bins: int = 8) -> DataFrame:
    """Mutual information, in nats, of a feature's equal-count bins and a label, by symbol."""
    rows = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).select("symbol", F.ntile(bins).over(Window.partitionBy("symbol").orderBy(feature, "seq")).alias("bin"), F.col(label).alias("label"))
    cells = rows.groupBy("symbol", "bin", "label").agg(F.count("*").alias("n"))
    s, b, y = Window.partitionBy("symbol"), Window.partitionBy("symbol", "bin"), Window.partitionBy("symbol", "label")
    cells = cells.withColumns({"t": F.sum("n").over(s), "nb": F.sum("n").over(b), "ny": F.sum("n").over(y)})
    return cells.groupBy("symbol").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nb") * F.col("ny")))).alias("mi"))


def hurst_rs(df: DataFrame, column: str, n: int = 100, least: int = 20) -> DataFrame:
    """ln(R/S) / ln(n) of the last n values, within 0 and 1; null with fewer than `least`."""
    values = F.collect_list(column).over(last_rows(n))
    df = df.withColumn("_v", values)
    size = F.size("_v")
    mean = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x) / size
    df = df.withColumn("_m", F.when(size >= least, mean))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0.0).alias("ss"))
    walk = F.aggregate(
        "_v",
        start,
        lambda a, x: F.struct(
            (a["c"] + x - F.col("_m")).alias("c"),
            F.least(a["lo"], a["c"] + x - F.col("_m")).alias("lo"),
            F.greatest(a["hi"], a["c"] + x - F.col("_m")).alias("hi"),
            (a["ss"] + (x - F.col("_m")) * (x - F.col("_m"))).alias("ss"),
        ),
    )
    df = df.withColumn("_w", walk)
    spread, sd = F.col("_w.hi") - F.col("_w.lo"), F.sqrt(F.col("_w.ss") / F.size("_v"))
    h = F.when((sd > 1e-12) & (spread > 0), F.log(spread / sd) / F.log(F.size("_v").cast("double"))).otherwise(0.5)
    return df.withColumn("hurst", F.when(F.size("_v") >= least, F.least(F.greatest(h, F.lit(0.0)), F.lit(1.0)))).drop("_v", "_m", "_w")


def streaks(df: DataFrame, won: Column) -> DataFrame:
    """longest_win and longest_loss in rows, by symbol."""
    rows = df.withColumn("_w", won.cast("int")).withColumn("_c", F.when(F.col("_w") == F.lag("_w").over(by_seq()), 0).otherwise(1)).withColumn("_s", F.sum("_c").over(so_far()))
    runs = rows.groupBy("symbol", "_s", "_w").agg(F.count("*").alias("n"))
    return runs.groupBy("symbol").agg(F.coalesce(F.max(F.when(F.col("_w") == 1, F.col("n"))), F.lit(0)).alias("longest_win"), F.coalesce(F.max(F.when(F.col("_w") == 0, F.col("n"))), F.lit(0)).alias("longest_loss"))


def balanced_sample(df: DataFrame, label: str, per_class: int, seed: int = 42) -> DataFrame:
    """Rows of each class in the order of a seeded hash, as many as its share of the smallest class allows and at most per_class on average: a threshold on the hash, so nothing is sorted."""
    counts = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("_n"))
    u = F.pmod(F.xxhash64(F.lit(seed), "symbol", "seq"), F.lit(1 << 30)) / float(1 << 30)
    return df.join(counts, F.col(label) == F.col("_l")).where(u < share).drop("_l", "_n")


def zigzag(df: DataFrame, multiple: float = 2.0, spacing: int = 5) -> DataFrame:
    """Pivots: a high (1) or low (-1) that price left by `multiple` times the ATR, at least `spacing` bars after the pivot before. Where the search stands depends on the last pivot, so a symbol is read in order."""

    def run(pdfs):
        key = None
        for pdf in pdfs:
            out = []
            for symbol, seq, high, low, atr in zip(pdf["symbol"], pdf["seq"], pdf["high"], pdf["low"], pdf["atr"]):
                if symbol != key:
                    key, side, best, at, last = symbol, 1, high, seq, -spacing
                step = multiple * atr if atr == atr else math.inf
                if side > 0:
                    if high >= best:
                        best, at = high, seq
                    elif best - low >= step and at - last >= spacing:
                        out.append((symbol, at, 1, best))
                        last, side, best, at = at, -1, low, seq
                else:
                    if low <= best:
                        best, at = low, seq
                    elif high - best >= step and at - last >= spacing:
                        out.append((symbol, at, -1, best))
                        last, side, best, at = at, 1, high, seq
            yield pd.DataFrame(out, columns=["symbol", "seq", "pivot", "price"])

    rows = df.select("symbol", "seq", "high", "low", "atr").repartition("symbol").sortWithinPartitions("symbol", "seq")
    return rows.mapInPandas(run, "symbol string, seq long, pivot int, price double")


def drawdown_regime(df: DataFrame, crisis: float = -0.15, recovered: float = -0.05, percentile: float = 0.8, n: int = 20) -> DataFrame:
    """df with drawdown (0 or less), volatility (of n returns) and label: crisis below `crisis`, recovery from then until the fall is within `recovered`, else normal_high_vol where volatility reaches its percentile over the symbol's bars, or normal_low_vol."""
    step = F.coalesce(F.try_divide("close", F.lag("close").over(by_seq())) - 1, F.lit(0.0))
    peak = F.max("close").over(so_far())
    df = df.withColumns({"_r": step, "drawdown": (F.col("close") - peak) / peak})
    df = df.withColumn("volatility", F.when(F.count("_r").over(last_rows(n)) >= n, F.stddev_samp("_r").over(last_rows(n))))
    df = hysteresis(df, F.col("drawdown") < crisis, F.col("drawdown") >= recovered, "_in")
    bounds = df.groupBy("symbol").agg(F.percentile("volatility", F.lit(percentile)).alias("_high"))
    high = F.coalesce(F.col("volatility"), F.lit(0.0)) >= F.col("_high")
    label = F.when(F.col("drawdown") < crisis, "crisis").when(F.col("_in") == 1, "recovery").when(high, "normal_high_vol").otherwise("normal_low_vol")
    return df.join(bounds, "symbol").withColumn("label", label).drop("_r", "_in", "_high")


# The share of a position that each mode takes.
MODE_SCALES = {"momentum_long": 1.0, "momentum_short": 0.8, "mean_reversion": 0.7, "cautious": 0.4, "defensive": 0.3, "neutral": 0.2}


def hybrid_mode(df: DataFrame, regime: Column, probability: Column, hurst: Column, volatility: Column, least: float = 0.6, low: float = 0.2, high: float = 1.0) -> DataFrame:
    """df with mode and scale, from the market's regime (bull, bear, sideways) and whether its Hurst exponent says trending (over 0.55), reverting (below 0.45) or neither.

    Without a regime or exponent the mode is neutral at the lowest scale; with a probability below `least`, cautious at 0.5.
    Else the mode's scale, times 0.7 to 1 for how far the exponent is from 0.5, times exp(-0.3 z) for a volatility z of its
    symbol's mean above 0, within low and high.
    """
    w = Window.partitionBy("symbol")
    df = df.withColumn("_v", volatility).withColumns({"_m": F.avg("_v").over(w), "_s": F.stddev_samp("_v").over(w)})
    trending, reverting = hurst > 0.55, hurst < 0.45
    mode = (
        F.when(regime.isNull() | hurst.isNull(), "neutral")
        .when(F.coalesce(probability, F.lit(0.0)) < least, "cautious")
        .when(reverting, "mean_reversion")
        .when((regime == "bull") & trending, "momentum_long")
        .when((regime == "bear") & trending, "momentum_short")
        .when(regime == "bull", "cautious")
        .when(regime == "bear", "defensive")
        .otherwise("neutral")
    )
    base = F.coalesce(*[F.when(mode == m, v) for m, v in MODE_SCALES.items()])
    calm = F.when((F.col("_m") > 0) & (F.col("_s") > 0), F.exp(-0.3 * F.greatest(F.lit(0.0), (F.col("_v") - F.col("_m")) / (F.col("_s") + 1e-10)))).otherwise(1.0)
    scaled = base * F.least(probability / least, F.lit(1.0)) * (0.7 + 0.3 * F.abs(hurst - 0.5) * 2) * F.coalesce(calm, F.lit(1.0))
    scale = F.when(regime.isNull() | hurst.isNull(), low).when(F.coalesce(probability, F.lit(0.0)) < least, 0.5).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), scaled)))
    return df.withColumns({"mode": mode, "scale": scale}).drop("_v", "_m", "_s")


def plateau_center(grid: DataFrame, axes: list[str], score: str = "score", q: float = 0.9) -> DataFrame:
    """The centre (axes), cells and best of the largest face-connected part of a score grid at or above its q-quantile; its best point if no part has two cells. Of equally large parts the one with the higher best score, then the smaller first cell.

    axes are whole numbers, a step apart between neighbours. A cell takes the least label among its neighbours' and its
    own until none changes; a round is a join on the cells' places, and as many rounds are needed as a part is long.
    """
    bound = grid.agg(F.percentile(score, F.lit(q)).alias("_c"))
    place = F.array(*[F.col(a).cast("long") for a in axes])
    cells = grid.join(F.broadcast(bound), F.col(score) >= F.col("_c")).select(place.alias("at"), F.col(score).cast("double").alias("s"), place.alias("label")).checkpoint()  # one row

    def beside(axis: int, by: int) -> Column:
        return F.transform("at", lambda x, i: F.when(i == axis, x + by).otherwise(x))

    moved = F.array(*[beside(i, by) for i in range(len(axes)) for by in (-1, 1)])
    while True:
        near = cells.select(F.explode(moved).alias("at"), F.col("label").alias("near")).groupBy("at").agg(F.min("near").alias("near"))
        new = cells.join(near, "at", "left").select("at", "s", F.least("label", F.coalesce("near", "label")).alias("label"), (F.coalesce("near", "label") < F.col("label")).alias("moved")).checkpoint()
        cells = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    best = F.max_by("at", F.struct("s", F.transform("at", lambda x: -x)))
    parts = cells.groupBy("label").agg(F.count("*").alias("cells"), *[F.rint(F.avg(F.element_at("at", i + 1))).alias(f"_m{i}") for i in range(len(axes))], F.max("s").alias("best"), best.alias("_b"))
    top = parts.orderBy(F.desc("cells"), F.desc("best"), "label").limit(1)
    return top.select(*[F.when(F.col("cells") >= 2, F.col(f"_m{i}")).otherwise(F.element_at("_b", i + 1)).cast("long").alias(a) for i, a in enumerate(axes)], "cells", "best")
