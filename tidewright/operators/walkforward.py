"""Walk-forward runs over a parameter grid, and what their folds say: choices, stability, decay from training to test, grades.

A grid point is a key of its own beside the symbol, so a recurrence over all points is one job with more keys. Results are
summed by day before they meet the folds that a day lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .automata import state_machine
from .windows import by_seq


def gridded(df: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """df once for each grid point: its parameters as columns, and symbol extended by the point's number (taken off again by ungridded)."""
    points = F.array(*[F.struct(F.lit(i).alias("_point"), *[F.lit(float(v)).alias(n) for n, v in g.items()]) for i, g in enumerate(grid)])
    out = df.withColumn("_g", F.explode(points)).select(*df.columns, "_g.*")
    return out.withColumn("symbol", F.concat_ws("#", "symbol", "_point")).drop("_point")


def ungridded(df: DataFrame) -> DataFrame:
    return df.withColumn("symbol", F.regexp_extract("symbol", r"^(.*)#\d+$", 1))


def band_results(df: DataFrame, z: str, fee: float = 0.0004) -> DataFrame:
    """symbol, entry, leave, day, pnl and trades of a rule that goes with z beyond entry until z is back within leave, with position at the close and a fee on each change. df: of gridded, with entry and leave."""
    x = F.coalesce(F.col(z), F.lit(0.0))
    fresh = F.when(x > F.col("entry"), 2).when(x < -F.col("entry"), 0).otherwise(1)
    moves = [F.when(x > -F.col("leave"), 1).otherwise(0), fresh, F.when(x < F.col("leave"), 1).otherwise(2)]
    held = state_machine(df, moves, "_s", start=1).withColumn("_p", F.col("_s") - 1)
    before = F.coalesce(F.lag("_p").over(by_seq()), F.lit(0))
    step = F.coalesce(F.try_divide("close", F.lag("close").over(by_seq())) - 1, F.lit(0.0))
    held = held.withColumns({"_pnl": before * step - fee * F.abs(F.col("_p") - before), "_turn": ((F.col("_p") != before) & (F.col("_p") != 0)).cast("int")})
    return ungridded(held).groupBy("symbol", "entry", "leave", F.to_date("bar_ts").alias("day")).agg(F.sum("_pnl").alias("pnl"), F.sum("_turn").alias("trades"))


def walk_forward(daily: DataFrame, folds: DataFrame, parameters: list[str], days: int = 365) -> DataFrame:
    """For each symbol and fold the parameters of the highest training Sharpe ratio (of those alike to nine places the smallest parameters) with train_ and test_ sharpe, pnl, and the test's trades, win rate by day, and largest fall.

    daily: symbol, parameters, day, pnl, trades; folds: as rolling_folds. A Sharpe ratio without deviation is 0. Folds
    without a day in training or test are left out.
    """
    met = daily.join(folds, "symbol").where("day >= train_start AND day < test_end").withColumn("test", F.col("day") >= F.col("test_start"))
    keys = ["symbol", "fold", *parameters]
    so_far = Window.partitionBy(*keys, "test").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_sum", F.sum("pnl").over(so_far)).withColumn("_fall", F.greatest(F.max("_sum").over(so_far), F.lit(0.0)) - F.col("_sum"))

    def over(part: Column, name: str):
        pnl = F.when(part, F.col("pnl"))
        sd = F.stddev_pop(pnl)
        return [F.coalesce(F.when(sd > 1e-12, F.avg(pnl) / sd * float(days) ** 0.5), F.lit(0.0)).alias(f"{name}_sharpe"), F.sum(pnl).alias(f"{name}_pnl")]

    test = F.col("test")
    stats = met.groupBy(*keys).agg(*over(~test, "train"), *over(test, "test"), F.sum(F.when(test, F.col("trades")).otherwise(0)).alias("test_trades"), F.avg(F.when(test, (F.col("pnl") > 0).cast("double"))).alias("test_win_rate"), F.max(F.when(test, F.col("_fall"))).alias("test_mdd"))
    whole = stats.where("train_pnl IS NOT NULL AND test_pnl IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("symbol", "fold").orderBy(F.desc(F.round("train_sharpe", 9)), *parameters))
    return whole.withColumn("_n", first).where("_n = 1").drop("_n")


def stability(choices: DataFrame, parameter: str) -> DataFrame:
    """symbol, value (the most common choice; of equally common ones that of the earliest fold), n and share. choices: symbol, fold, parameter."""
    counts = choices.groupBy("symbol", F.col(parameter).alias("value")).agg(F.count("*").alias("n"), F.min("fold").alias("_f"))
    first = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "_f"))
    total = F.sum("n").over(Window.partitionBy("symbol"))
    return counts.withColumns({"share": F.col("n") / total, "_r": first}).where("_r = 1").drop("_f", "_r")


def fold_verdict(folds: DataFrame, parameters: list[str]) -> DataFrame:
    """By symbol: folds, mean and deviation of both Sharpe ratios, overfit ratio (infinite where the test's mean isn't positive), compounded and mean test pnl, trades, mean parameter stability, share of folds with a positive test, and the grades that follow."""
    out = folds.groupBy("symbol").agg(
        F.count("*").alias("folds"),
        F.avg("train_sharpe").alias("avg_train_sharpe"),
        F.avg("test_sharpe").alias("avg_test_sharpe"),
        F.stddev_pop("test_sharpe").alias("std_test_sharpe"),
        (F.exp(F.sum(F.log(F.greatest(1 + F.col("test_pnl"), F.lit(1e-12))))) - 1).alias("cumulative_pnl"),
        F.avg("test_pnl").alias("avg_test_pnl"),
        F.sum("test_trades").alias("total_trades"),
        F.avg("test_mdd").alias("avg_mdd"),
        F.avg((F.col("test_sharpe") > 0).cast("double")).alias("consistency"),
    )
    shares = None
    for p in parameters:
        own = stability(folds, p).select("symbol", F.col("share").alias(f"_s_{p}"))
        shares = own if shares is None else shares.join(own, "symbol")
    out = out.join(shares.select("symbol", (sum((F.col(f"_s_{p}") for p in parameters), F.lit(0.0)) / len(parameters)).alias("param_stability")), "symbol")
    ratio = F.when(F.col("avg_test_sharpe") > 0, F.col("avg_train_sharpe") / F.col("avg_test_sharpe")).otherwise(float("inf"))
    graded = lambda x, low, high, names: F.when(x > high, names[0]).when(x > low, names[1]).otherwise(names[2])
    out = out.withColumn("overfit_ratio", ratio).withColumns({
        "overfit_grade": F.when(F.col("overfit_ratio") < 1.3, "LOW").when(F.col("overfit_ratio") < 1.7, "MODERATE").otherwise("HIGH"),
        "stability_grade": graded(F.col("param_stability"), 0.4, 0.6, ("STABLE", "MODERATE", "UNSTABLE")),
        "consistency_grade": graded(F.col("consistency"), 0.5, 0.7, ("CONSISTENT", "MODERATE", "INCONSISTENT")),
    })
    points = lambda c: F.when(F.col(c).isin("LOW", "STABLE", "CONSISTENT"), 3).when(F.col(c) == "MODERATE", 2).otherwise(1)
    score = (points("overfit_grade") + points("stability_grade") + points("consistency_grade")) / 3
    return out.withColumn("overall_grade", F.when(score >= 2.5, "ROBUST").when(score >= 2.0, "ACCEPTABLE").otherwise("WEAK"))


def in_and_out(folds: DataFrame) -> DataFrame:
    """By symbol: mean, deviation and share above 0 of training and test pnl, the loss of pnl and of Sharpe ratio from one to the other, their correlation (0 for one fold), and the sum of test pnl."""
    both = [("is", "train"), ("oos", "test")]
    sums = [x for n, c in both for x in (F.avg(f"{c}_pnl").alias(f"{n}_return_mean"), F.stddev_pop(f"{c}_pnl").alias(f"{n}_return_std"), F.avg(f"{c}_sharpe").alias(f"{n}_sharpe_mean"), (F.avg((F.col(f"{c}_pnl") > 0).cast("double")) * 100).alias(f"{n}_win_rate"))]
    out = folds.groupBy("symbol").agg(F.count("*").alias("folds"), *sums, F.sum("test_pnl").alias("oos_cumulative"), F.coalesce(F.nanvl(F.corr("train_pnl", "test_pnl"), F.lit(0.0)), F.lit(0.0)).alias("is_oos_correlation"))
    return out.withColumns({"return_degradation": F.col("is_return_mean") - F.col("oos_return_mean"), "sharpe_degradation": F.col("is_sharpe_mean") - F.col("oos_sharpe_mean")})


def run_score(pnl: Column, sharpe: Column, mdd: Column, win_rate: Column, trades: Column) -> Column:
    """-100 with fewer than three trades, else 100 pnl + 10 sharpe - 50 mdd + 20 times what the win rate is above one half."""
    return F.when(trades < 3, -100.0).otherwise(100 * pnl + 10 * sharpe - 50 * mdd + 20 * F.greatest(F.lit(0.0), win_rate - 0.5))


def composite(df: DataFrame, weights: dict[str, float], valid: Column | None = None, within: list[str] | None = None) -> DataFrame:
    """df with score: the weighted sum of columns, each scaled to 0 and 1 over the valid rows of its group (0 where they are all alike); rows that aren't valid score 0."""
    ok = valid if valid is not None else F.lit(True)
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    parts = []
    for c, weight in weights.items():
        low, high = F.min(F.when(ok, F.col(c))).over(w), F.max(F.when(ok, F.col(c))).over(w)
        parts.append(weight * F.when(high > low, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - low) / (high - low)))).otherwise(0.0))
    return df.withColumn("score", F.when(ok, F.coalesce(sum(parts, F.lit(0.0)), F.lit(0.0))).otherwise(0.0))
