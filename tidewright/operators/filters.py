"""State filters: the adaptive trend and velocity filter, and the one with acceleration.

Measurement noise, time steps and logs are Columns of bounded windows. The recursion, whose process noise depends on what
the filter did before, is an ordered pass with a state of constant size (see automata.ordered).
"""

from __future__ import annotations

from collections import deque
from math import exp, log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automata import known, ordered
from .windows import by_seq, last_rows

WINDOW, INITIAL, LEAST_R, LEAST_Q = 20, 1.0, 1e-8, 1e-10
#: The 20 columns of adaptive_filter, and the 9 of acceleration_filter.
COLUMNS2 = tuple(f"kf_{c}" for c in "trend trend_pred velocity velocity_var deviation deviation_pct gain uncertainty uncertainty_pred innovation_cov innovation_cov_risk innovation nis nis_boost r_trend r_risk std_innovation stop_distance velocity_zscore signal".split())
COLUMNS3 = tuple(f"kf_{c}" for c in "trend velocity acceleration deviation deviation_pct gain uncertainty innovation std_innovation".split())


def _variance(values: Column) -> Column:
    """Population variance of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")), lambda a: a["s"] / n)


def close_noise(y: str, n: int = WINDOW, scale: float = 1.0) -> Column:
    """The variance of the steps between the known values of column y among the last n rows; INITIAL on a first row or with fewer than two known."""
    values = F.collect_list(y).over(last_rows(n))  # nulls are left out
    steps = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a - b)
    first = (F.row_number().over(by_seq()) == 1) | (F.size(values) < 2)
    return F.when(first, INITIAL * scale).otherwise(F.greatest(_variance(steps) * scale, F.lit(LEAST_R)))


def range_noise(high: Column, low: Column, n: int = WINDOW, scale: float = 1.0) -> Column:
    """Parkinson's variance of the last n rows with a known range; INITIAL on a first row or with fewer than two."""
    spread = log_of(high) - log_of(low)
    w = last_rows(n)
    first = (F.row_number().over(by_seq()) == 1) | (F.count(spread).over(w) < 2)
    return F.when(first, INITIAL * scale).otherwise(F.greatest(F.avg(spread * spread).over(w) / (4 * log(2)) * scale, F.lit(LEAST_R)))


def log_of(price: Column) -> Column:
    return F.when(price > 0, F.log(price))


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def adaptive_filter(
    df: DataFrame,
    hours: Column | None = None,
    q_scale: float = 0.4,
    momentum: float = 2.0,
    acceleration_scale: float = 0.4,
    nis_weight: float | None = 3.0,
    nis_cap: float = 20.0,
    directional: float | None = None,
    r_scale: float = 1.0,
    window: int = WINDOW,
) -> DataFrame:
    """df with the 20 columns COLUMNS2 of a two-state filter (trend and velocity) of the log typical price. df: symbol, seq, high, low, close.

    hours: each bar's time step (6 where null or absent). Process noise is white acceleration over the step, its variance that of
    the last window - 1 velocities times q_scale and a factor that grows as velocity changes (momentum); it is raised by nis_weight
    times the bar before's squared innovation over its variance, within 1 and nis_cap (None: never), and with `directional`
    also by exp(-directional * the standardised innovation before), within 0.2 and 5, the larger of both. A row without a
    price only predicts: it has no innovation, and gain 0. Rows before a symbol's first price have nulls.

    Velocities count from a symbol's first price, their window from its first row, so that rows without a price at
    the start shorten it.
    """
    rows = df.withColumns({"_y": log_of(_typical()), "_dt": F.coalesce(hours.cast("double") if hours is not None else F.lit(None).cast("double"), F.lit(6.0))})
    rows = rows.withColumns({"_rt": close_noise("_y", window, r_scale), "_rr": range_noise(F.col("high"), F.col("low"), window, r_scale)})
    noise = rows.select("symbol", "seq", "_y", "_dt", "_rt", "_rr")

    def machine():
        x = v = p01 = 0.0
        p00 = p11 = INITIAL
        started, idx, skipped, nis, shift = False, -1, 0, None, None
        speeds: deque[float] = deque(maxlen=window - 1)
        nothing = (None,) * 13

        def base_q() -> float:
            n = idx - skipped - max(0, idx - window + 1)
            recent = list(speeds)[-n:] if n > 0 else []
            if len(recent) < 2:
                return LEAST_Q
            mean = sum(recent) / len(recent)
            var = sum((s - mean) ** 2 for s in recent) / len(recent)
            factor = 1.0
            if len(recent) >= 3:
                change = (abs(recent[-1] - recent[-2]) + abs(recent[-2] - recent[-3])) / 2
                factor += momentum * change / (sum(map(abs, recent)) / len(recent) + 1e-10)
            return max(var * q_scale * factor, LEAST_Q)

        def step(y, dt, r_trend, r_risk):
            nonlocal x, v, p00, p01, p11, started, idx, skipped, nis, shift
            idx += 1
            if not started:
                if not known(y):
                    skipped += 1
                    return nothing
                started, x = True, y
            boost = 1.0 if nis_weight is None or nis is None else max(1.0, min(nis * nis_weight, nis_cap))
            if directional is not None and shift is not None and known(y):
                turned = min(max(exp(-directional * shift), 0.2), 5.0)
                boost = turned if nis_weight is None else max(boost, turned)
            a = base_q() * acceleration_scale * boost
            x_pred = x + dt * v
            n00 = p00 + 2 * dt * p01 + dt * dt * p11 + max(a * dt**4 / 4, LEAST_Q)
            n01 = p01 + dt * p11 + max(a * dt**3 / 2, LEAST_Q)
            n11 = p11 + max(a * dt * dt, LEAST_Q)
            if not known(y):
                x, p00, p01, p11 = x_pred, n00, n01, n11
                speeds.append(v)
                return x, x_pred, v, p11, 0.0, p00, n00, None, None, None, None, None, None
            s, e = n00 + r_trend, y - x_pred
            k0, k1 = n00 / s, n01 / s
            nis, shift = e * e / s, e / (sqrt(s) + 1e-10)
            x, v = x_pred + k0 * e, v + k1 * e
            p00, p01, p11 = (1 - k0) * n00, (1 - k0) * n01, n11 - k1 * n01
            speeds.append(v)
            return x, x_pred, v, p11, k0, p00, n00, s, n00 + r_risk, e, nis, boost, shift

        return step

    fields = "_x _xp kf_velocity kf_velocity_var kf_gain kf_uncertainty kf_uncertainty_pred kf_innovation_cov kf_innovation_cov_risk kf_innovation kf_nis kf_nis_boost kf_std_innovation".split()
    found = ordered(noise, machine, ", ".join(f"{f} double" for f in fields))
    out = rows.drop("_y", "_dt").join(found, ["symbol", "seq"])
    trend, seen = F.exp("_x"), F.col("kf_nis").isNotNull()
    out = out.withColumns({
        "kf_trend": trend,
        "kf_trend_pred": F.exp("_xp"),
        "kf_deviation": _typical() - trend,
        "kf_deviation_pct": (_typical() - trend) / (trend + 1e-10) * 100,
        "kf_r_trend": F.when(seen, F.col("_rt")),
        "kf_r_risk": F.when(seen, F.col("_rr")),
        "kf_stop_distance": 3 * F.sqrt("kf_innovation_cov_risk"),
        "kf_velocity_zscore": F.col("kf_velocity") / (F.sqrt("kf_velocity_var") + 1e-10),
    })
    w = last_rows(window)
    spread = F.when(F.count("kf_deviation").over(w) >= 5, F.stddev_samp("kf_deviation").over(w))
    return out.withColumn("kf_signal", F.col("kf_deviation") / (spread + 1e-10)).select(*df.columns, *COLUMNS2)


def acceleration_filter(df: DataFrame, q_trend: float = 0.01, q_velocity: float = 0.1, q_acceleration: float = 1.0, r_scale: float = 1.0) -> DataFrame:
    """df with the 9 columns COLUMNS3 of a three-state filter: position, velocity and acceleration of the log typical price, one step a row.

    Process noise is LEAST_Q times each state's factor, those of velocity and acceleration raised by ten times the variance
    of the last 20 accelerations where that is over 1. A row without a price only predicts; rows before the first price
    have nulls.
    """
    rows = df.withColumn("_y", log_of(_typical()))
    noise = rows.withColumn("_r", close_noise("_y", scale=r_scale)).select("symbol", "seq", "_y", "_r")

    def machine():
        x = v = a = p01 = p02 = p12 = 0.0
        p00 = p11 = p22 = INITIAL
        started = False
        past: deque[float] = deque(maxlen=WINDOW)

        def step(y, r):
            nonlocal x, v, a, p00, p01, p02, p11, p12, p22, started
            if not started:
                if not known(y):
                    return (None,) * 7
                started, x = True, y
            mean = sum(past) / len(past) if past else 0.0
            var = sum((s - mean) ** 2 for s in past) / len(past) if len(past) > 1 else 0.0
            raised = max(1.0, 10 * var) * LEAST_Q
            x, v = x + v + a / 2, v + a
            a0, a1, a2, b1, b2 = p00 + p01 + p02 / 2, p01 + p11 + p12 / 2, p02 + p12 + p22 / 2, p11 + p12, p12 + p22
            p00, p01, p02, p11, p12, p22 = a0 + a1 + a2 / 2 + q_trend * LEAST_Q, a1 + a2, a2, b1 + b2 + q_velocity * raised, b2, p22 + q_acceleration * raised
            if not known(y):
                past.append(a)
                return x, v, a, None, p00, None, None
            s, e = p00 + r, y - x
            k0, k1, k2 = p00 / s, p01 / s, p02 / s
            x, v, a = x + k0 * e, v + k1 * e, a + k2 * e
            p11, p12, p22 = p11 - k1 * p01, p12 - k1 * p02, p22 - k2 * p02
            p00, p01, p02 = p00 - k0 * p00, p01 - k0 * p01, p02 - k0 * p02
            past.append(a)
            return x, v, a, k0, p00, e, e / (sqrt(s) + 1e-10)

        return step

    found = ordered(noise, machine, "_x double, kf_velocity double, kf_acceleration double, kf_gain double, kf_uncertainty double, kf_innovation double, kf_std_innovation double")
    trend = F.exp("_x")
    out = rows.drop("_y").join(found, ["symbol", "seq"]).withColumns({"kf_trend": trend, "kf_deviation": _typical() - trend, "kf_deviation_pct": (_typical() - trend) / (trend + 1e-10) * 100})
    return out.select(*df.columns, *COLUMNS3)


def dual_filter(df: DataFrame, hours: Column | None = None, fast: int = 20, slow: int = 120) -> DataFrame:
    """df with fast_ and slow_ velocity, zscore (of the velocity by its own variance) and uncertainty of two filters with noise windows of `fast` and `slow` rows, spread (of velocities), spread_std (50 rows, 10 at least) and the fast one's risk variance."""
    parts = {}
    for name, n in (("fast", fast), ("slow", slow)):
        own = adaptive_filter(df, hours, window=n)
        parts[name] = own.select("symbol", "seq", F.col("kf_velocity").alias(f"{name}_velocity"), F.col("kf_velocity_zscore").alias(f"{name}_zscore"), F.col("kf_uncertainty").alias(f"{name}_uncertainty"), *(["kf_innovation_cov_risk"] if name == "fast" else []))
    out = df.join(parts["fast"], ["symbol", "seq"]).join(parts["slow"], ["symbol", "seq"]).withColumn("spread", F.col("fast_velocity") - F.col("slow_velocity"))
    w = last_rows(50)
    return out.withColumn("spread_std", F.when(F.count("spread").over(w) >= 10, F.stddev_samp("spread").over(w)))


def derived(df: DataFrame) -> DataFrame:
    """Of the filter's columns: averages of velocity over 5 and 20 rows and their difference, 5-row change of velocity, velocity's z over 42 rows, the sign of a cross of both averages, and the deviation's z over 50 rows."""
    w5, w20, w42, w50 = last_rows(5), last_rows(20), last_rows(42), last_rows(50)
    v, gap = F.col("kf_velocity"), F.log(F.col("close") / F.col("kf_trend"))
    df = df.withColumns({"vel_ma5": F.avg(v).over(w5), "vel_ma20": F.avg(v).over(w20), "vel_accel": v - F.lag(v, 5).over(by_seq()), "vel_z": F.when(F.count(v).over(w42) >= 5, (v - F.avg(v).over(w42)) / (F.stddev_samp(v).over(w42) + 1e-10)), "dev_z": (gap - F.avg(gap).over(w50)) / (F.stddev_samp(gap).over(w50) + 1e-10)})
    df = df.withColumn("vel_diff", F.col("vel_ma5") - F.col("vel_ma20"))
    return df.withColumn("vel_cross", F.when((F.col("vel_diff") > 0) & (F.lag("vel_diff").over(by_seq()) <= 0), 1).when((F.col("vel_diff") < 0) & (F.lag("vel_diff").over(by_seq()) >= 0), -1).otherwise(0))


def hybrid_volatility(df: DataFrame, n: int = 42, baseline: int = 120) -> DataFrame:
    """sigma_hybrid: the larger of the filter's root uncertainty and the deviation of log returns over n rows (10 at least); v_ratio: that over its mean of `baseline` rows (30 at least)."""
    w = last_rows(n)
    step = F.coalesce(F.log(F.col("close") / F.lag("close").over(by_seq())), F.lit(0.0))
    df = df.withColumn("_r", step)
    sd = F.when(F.count("_r").over(w) >= 10, F.stddev_samp("_r").over(w))
    df = df.withColumn("sigma_hybrid", F.when(sd.isNotNull() & F.col("kf_uncertainty").isNotNull(), F.greatest(F.sqrt("kf_uncertainty"), sd)))
    b = last_rows(baseline)
    return df.withColumn("v_ratio", F.when(F.count("sigma_hybrid").over(b) >= 30, F.col("sigma_hybrid") / (F.avg("sigma_hybrid").over(b) + 1e-10))).drop("_r")


def excursion_multiples(df: DataFrame, width: Column, horizon: int = 6, window: int = 180, q: float = 0.99, least: int = 10) -> DataFrame:
    """mae_long, mae_short, k_long, k_short: percentiles, among the `window` entries whose horizon had ended before the bar, of the log move against an entry at the open, and of that over the mean width of the horizon's bars.

    Null before row window + horizon + 2, and with fewer than `least` whole entries.
    """
    ahead = by_seq().rowsBetween(1, horizon)
    df = df.withColumn("_w", width)
    sides = {"long": F.log(F.try_divide("open", F.min("low").over(ahead))), "short": F.log(F.try_divide(F.max("high").over(ahead), "open"))}
    whole = (F.count("low").over(ahead) == horizon) & (F.count("high").over(ahead) == horizon) & (F.col("open") > 0)
    mean = F.when((F.count("_w").over(ahead) == horizon), F.avg("_w").over(ahead))
    df = df.withColumns({f"_m_{s}": F.when(whole, m) for s, m in sides.items()} | {"_a": mean})
    df = df.withColumns({f"_k_{s}": F.when(F.col("_a") > 1e-10, F.col(f"_m_{s}") / F.col("_a")) for s in sides})
    before = by_seq().rowsBetween(-window - horizon, -horizon - 1)
    late = F.row_number().over(by_seq()) > window + horizon + 1
    names = {"mae_long": "_m_long", "mae_short": "_m_short", "k_long": "_k_long", "k_short": "_k_short"}
    df = df.withColumns({n: F.when(late & (F.count(c).over(before) >= least), F.percentile(c, F.lit(q)).over(before)) for n, c in names.items()})
    return df.drop("_w", "_a", *names.values())
