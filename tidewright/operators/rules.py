"""Per-row formulas: bar features, costs, sizes, levels, and entry and exit predicates. All are Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automata import state_machine
from .windows import by_seq, last_rows, rank_pct

EPS = 1e-10
c = F.col


def bar_features(df: DataFrame) -> DataFrame:
    hour, day = F.hour("bar_ts"), F.dayofweek("bar_ts") - 1
    return df.withColumns(
        {
            "log_volume": F.log1p("volume"),
            "log_tick_count": F.log1p("ticks"),
            "log_duration": F.log1p("duration"),
            "log_trade_intensity": F.log1p(c("dollar") / F.greatest(c("duration"), F.lit(EPS))),
            "vwap_dev": (c("close") - c("dollar") / F.greatest(c("volume"), F.lit(EPS))) / (c("close") + EPS),
            "imbalance": (2 * c("buy") - c("dollar")) / F.greatest(c("dollar"), F.lit(EPS)),
            "range_pct": (c("high") - c("low")) / c("close"),
            "body_pct": (c("close") - c("open")) / c("close"),
            "vwap": c("dollar") / (c("volume") + EPS),
            "buy_ratio": c("buy") / (c("dollar") + EPS),
            "avg_trade_size": c("dollar") / (c("ticks") + EPS),
            "hour_sin": F.sin(2 * math.pi * hour / 24),
            "hour_cos": F.cos(2 * math.pi * hour / 24),
            "day_sin": F.sin(2 * math.pi * day / 7),
            "day_cos": F.cos(2 * math.pi * day / 7),
            "typ_price": (c("high") + c("low") + c("close")) / 3,
        }
    )


def soft_clip(z: Column, limit: float = 5.0) -> Column:
    return limit * F.tanh(z / limit)


def slippage(sigma: Column, size: Column, avg_volume: Column, base: float = 0.0001, eta: float = 0.1, cap: float = 0.005) -> Column:
    ratio = size / avg_volume
    found = base + eta * sigma * F.sqrt(F.greatest(ratio, F.lit(0.0)))
    return F.when(avg_volume <= 0, cap).otherwise(F.least(F.lit(cap), found))


def round_trip_cost(slip: Column, fee: float = 0.0004) -> Column:
    return 2 * (fee + slip)


def fill_price(price: Column, direction: Column, slip: Column, entry: bool = True) -> Column:
    worse = direction if entry else -direction
    return price * (1 + worse * slip)


def net_pnl(entry: Column, leave: Column, direction: Column, fee: float = 0.0004) -> Column:
    return direction * (leave - entry) / entry - 2 * fee


def fee_trap(sigma: Column, cost: Column, pt: float, buffer: float = 1.5) -> Column:
    return pt * sigma > buffer * cost


def breakeven(sigma: Column, cost: Column, buffer: float = 1.5) -> Column:
    return F.when(sigma > 0, buffer * cost / sigma).otherwise(F.lit(float("inf")))


def normal_cdf(x: Column) -> Column:
    """By Abramowitz and Stegun's 7.1.26; the error is below 1.5e-7."""
    # The formula's coefficients.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + p * z)
    poly = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def size_gaussian(u: Column, most: float = 2.0, sigma: float = 0.5) -> Column:
    return most * F.exp(-u * u / (2 * sigma * sigma))


def size_cosine(u: Column, most: float = 2.0) -> Column:
    return most / 2 * (1 + F.cos(math.pi * u))


def size_poly(u: Column, most: float = 2.0, k: float = 2.0) -> Column:
    return most * F.pow(1 - u, F.lit(k))


def size_tanh(u: Column, s: float = 0.5, lam: float = 4.0) -> Column:
    return 1 + s * F.tanh(lam * (0.5 - u))


def size_kf_prob(v: Column, variance: Column, low: float = 0.5, high: float = 2.0) -> Column:
    p = normal_cdf(F.abs(v / F.sqrt(variance)))
    return low + (high - low) * F.least(F.greatest(2 * p - 1, F.lit(0.0)), F.lit(1.0))


def osc_zone(k: Column) -> Column:
    return F.when(k > 80, 1).when(k < 20, -1).otherwise(0)


def confident_signal(down: Column, flat: Column, up: Column, threshold: float) -> Column:
    most = F.greatest(down, flat, up)
    return F.when(most < threshold, 0).when(most == up, 1).when(most == down, -1).otherwise(0)


# ---- rules: entries and exits for long and short; tr trend, tp predicted trend, v velocity, u uncertainty ----


def _rule(enter_long, enter_short, exit_long, exit_short) -> dict[str, Column]:
    return {"enter_long": enter_long, "enter_short": enter_short, "exit_long": exit_long, "exit_short": exit_short}


def rule_breakout(k: float = 1.0) -> dict[str, Column]:
    band = k * F.sqrt("u")
    return _rule(c("close") > c("tr") + band, c("close") < c("tr") - band, c("close") < c("tr"), c("close") > c("tr"))


def rule_predictive(k: float = 1.0) -> dict[str, Column]:
    prev = F.lag("close").over(by_seq())
    band = k * F.sqrt(F.coalesce(F.lag("u").over(by_seq()), F.lit(1.0)))
    up, down = c("tp") > prev + band, c("tp") < prev - band
    return _rule(up, down, down, up)


def rule_fused(k: float = 1.0) -> dict[str, Column]:
    p = rule_predictive(k)
    return _rule(p["enter_long"] & (c("v") > 0), p["enter_short"] & (c("v") < 0), c("close") < c("tr"), c("close") > c("tr"))


def rule_scalp(threshold: float) -> dict[str, Column]:
    pace = c("v") / c("close")
    return _rule(pace > threshold, pace < -threshold, c("v") < 0, c("v") > 0)


def rule_mean_reversion(k: float = 1.0, k_exit: float = 0.0) -> dict[str, Column]:
    band, near = k * F.sqrt("u"), k_exit * F.sqrt("u")
    return _rule(c("close") < c("tr") - band, c("close") > c("tr") + band, c("close") > c("tr") - near, c("close") < c("tr") + near)


def rule_osc_fade(oversold: float = 20, overbought: float = 80) -> dict[str, Column]:
    prev = F.lag("close").over(by_seq())
    return _rule((c("stoch_k") < oversold) & (c("tp") > prev), (c("stoch_k") > overbought) & (c("tp") < prev), c("stoch_k") > 50, c("stoch_k") < 50)


def rule_channel() -> dict[str, Column]:
    return _rule(c("close") > c("entry_upper"), c("close") < c("entry_lower"), c("close") < c("exit_lower"), c("close") > c("exit_upper"))


def rule_zscore(entry: float = 2.0, leave: float = 0.0) -> dict[str, Column]:
    return _rule(c("z") > entry, c("z") < -entry, c("z") < leave, c("z") > -leave)


def rule_v2_breakout(k: float = 1.0) -> dict[str, Column]:
    band = k * c("u")
    return _rule((c("close") > c("tr") + band) & (c("v") > 0), (c("close") < c("tr") - band) & (c("v") < 0), c("close") < c("tr"), c("close") > c("tr"))


def rule_v2_predictive(k: float = 1.0) -> dict[str, Column]:
    prev, band = F.lag("close").over(by_seq()), k * F.coalesce(F.lag("u").over(by_seq()), F.lit(1.0))
    up, down = c("tp") > prev + band, c("tp") < prev - band
    return _rule(up, down, down, up)


def rule_v2_triple(k: float = 1.0) -> dict[str, Column]:
    p = rule_v2_predictive(k)
    return _rule(p["enter_long"] & (c("v") > 0), p["enter_short"] & (c("v") < 0), c("close") < c("tr"), c("close") > c("tr"))


def rule_v3_predictive(k: float = 1.0) -> dict[str, Column]:
    prev, band = F.lag("close").over(by_seq()), k * F.sqrt("u")
    up, down = c("tp") > prev + band, c("tp") < prev - band
    return _rule(up, down, down, up)


def rule_v3_fused(k: float = 1.0) -> dict[str, Column]:
    p = rule_v3_predictive(k)
    return _rule(p["enter_long"] & (c("v") > 0), p["enter_short"] & (c("v") < 0), c("close") < c("tr"), c("close") > c("tr"))


def rule_osc(k: float = 1.0, k_exit: float = 0.5, oversold: float = 20, overbought: float = 80) -> dict[str, Column]:
    """A forecast beyond the band while the oscillator has room; left near the trend, on its far side."""
    p, near = rule_v3_predictive(k), k_exit * F.sqrt("u")
    out_long = (c("close") > c("tr") - near) & (c("close") > c("tr"))
    out_short = (c("close") < c("tr") + near) & (c("close") < c("tr"))
    return _rule(p["enter_long"] & (c("stoch_k") < overbought), p["enter_short"] & (c("stoch_k") > oversold), out_long, out_short)


def rule_crossover(least: float = 0.0) -> dict[str, Column]:
    """The fast trend crosses the slow one while the slow one moves the same way; left at the opposite cross."""
    gap = c("fast") - c("tr")
    before = F.lag(gap).over(by_seq())
    up, down = (gap > 0) & (before <= 0), (gap < 0) & (before >= 0)
    return _rule(up & (c("v") > least), down & (c("v") < -least), down, up)


#: Each rule with the latch policy that its positions follow ("switch": the last signal holds).
POLICIES = {
    "breakout": (rule_breakout, "a"),
    "fused": (rule_fused, "d"),
    "scalp": (lambda: rule_scalp(0.0005), "f"),
    "v2_breakout": (rule_v2_breakout, "f"),
    "v2_predictive": (rule_v2_predictive, "switch"),
    "v2_triple": (rule_v2_triple, "f"),
    "v3_breakout_rev": (rule_breakout, "e"),
    "v3_predictive_rev": (rule_v3_predictive, "c"),
    "v3_fused_rev": (rule_v3_fused, "e"),
    "mean_reversion": (rule_mean_reversion, "d"),
    "mr_tight": (lambda: rule_mean_reversion(1.0, 0.5), "d"),
    "mr_reversal": (rule_mean_reversion, "e"),
    "osc_basic": (rule_osc, "c"),
    "osc_exit": (rule_osc, "d"),
    "osc_fade": (rule_osc_fade, "d"),
    "crossover": (rule_crossover, "b"),
    "channel": (rule_channel, "bd"),
}

RULES = {"breakout": rule_breakout, "predictive": rule_predictive, "fused": rule_fused, "scalp": rule_scalp, "mean_reversion": rule_mean_reversion, "osc_fade": rule_osc_fade, "channel": rule_channel, "zscore": rule_zscore}


def osc_combo(df: DataFrame, k: float = 1.0, oversold: float = 20, overbought: float = 80) -> DataFrame:
    """df with position and entry_type (trend, fade, or null while flat) of a rule that follows a forecast beyond the band while the oscillator is between both bounds, and fades an extreme that the forecast turns from.

    A trend entry is left at the far side of the trend, a fade when the oscillator has come back over the middle; an entry
    of the other side turns at once, whatever was held. Five states: flat, trend long, trend short, fade long, fade short.
    """
    prev = F.coalesce(F.lag("close").over(by_seq()), c("close"))
    low, high = F.coalesce(c("stoch_k") < oversold, F.lit(False)), F.coalesce(c("stoch_k") > overbought, F.lit(False))
    band, between = k * F.sqrt("u"), ~F.coalesce(c("stoch_k") < oversold, F.lit(False)) & ~F.coalesce(c("stoch_k") > overbought, F.lit(False))
    fade_long, fade_short = low & (c("tp") > prev), high & (c("tp") < prev)
    trend_long, trend_short = between & (c("tp") > prev + band) & (c("v") > 0), between & (c("tp") < prev - band) & (c("v") < 0)
    into_long = F.when(fade_long, 3).when(trend_long, 1)
    into_short = F.when(fade_short, 4).when(trend_short, 2)
    to = lambda entry, leave, held: F.coalesce(entry, F.when(leave, 0), F.lit(held))
    moves = [
        F.coalesce(into_long, into_short, F.lit(0)),
        to(into_short, c("close") < c("tr"), 1),
        to(into_long, c("close") > c("tr"), 2),
        to(into_short, c("stoch_k") > 50, 3),
        to(into_long, c("stoch_k") < 50, 4),
    ]
    df = state_machine(df, moves, "_s")
    return df.withColumns({"position": F.when(c("_s").isin(1, 3), 1).when(c("_s").isin(2, 4), -1).otherwise(0), "entry_type": F.when(c("_s").isin(1, 2), "trend").when(c("_s").isin(3, 4), "fade")}).drop("_s")


def long_signals(fast: float = 2.0, slow: float = 1.0, slow_high: float = 2.0, ratio: float = 0.5) -> dict[str, Column]:
    """The 11 long signals of fast_zscore, slow_zscore, and a bar's duration against its average (duration_ma); false where one of them is null."""
    known = c("fast_zscore").isNotNull() & c("slow_zscore").isNotNull() & c("duration").isNotNull() & c("duration_ma").isNotNull()
    fast_only, high, up = c("fast_zscore") > fast, c("slow_zscore") > slow_high, c("slow_zscore") > slow
    short = fast_only & (c("duration") < c("duration_ma") * ratio)
    aligned = fast_only & up
    named = {
        "VelVolume": short,
        "TrendAlign": aligned,
        "FastOnly": fast_only,
        "SlowZ": high,
        "VelTrend": short & up,
        "VelSlow": short & high,
        "AllThree": short & up,
        "OR_VelTrend": short | aligned,
        "OR_VelSlow": short | high,
        "OR_FastSlow": fast_only | high,
        "OR_All": short | aligned | high,
    }
    return {n: F.coalesce(known & x, F.lit(False)) for n, x in named.items()}


def short_signals(fast: float = 2.0, slow_high: float = 2.0) -> dict[str, Column]:
    """The 4 short signals of fast_zscore, slow_zscore, spread over spread_std, and ticks below their lower quartile (tick_p25)."""
    known = c("fast_zscore").isNotNull() & c("slow_zscore").isNotNull()
    down = c("fast_zscore") < -fast
    wide = lambda k: down & (c("spread_std") > 0) & (c("spread") < -k * c("spread_std"))
    named = {"Spread": wide(1.0), "SpreadTight": wide(1.5), "SlowTick": (c("slow_zscore") < -slow_high) & (c("ticks") < c("tick_p25")), "FastOnly": down}
    return {n: F.coalesce(known & x, F.lit(False)) for n, x in named.items()}


def rule_impulse(entry: float = 1.0, overbought: float = 70, oversold: float = 30) -> dict[str, Column]:
    """With the velocity on a z_score beyond entry while kf_rsi has room, in a trend; left when it ends or the close crosses the trend."""
    trending = c("trending")
    up = trending & (c("kf_velocity") > 0) & (c("z_score") > entry) & (c("kf_rsi") < overbought)
    down = trending & (c("kf_velocity") < 0) & (c("z_score") < -entry) & (c("kf_rsi") > oversold)
    return _rule(up, down, ~trending | (c("close") < c("kf_trend")), ~trending | (c("close") > c("kf_trend")))


def rule_dual_track(breakout: float = 1.75, rsi: tuple[float, float] = (25, 75), pullback: tuple[float, float] = (-0.5, 0.5), rsi_back: tuple[float, float] = (40, 60), buffer: float = 1.5) -> dict[str, Column]:
    """An impulse beyond `breakout`, or in a trend a z_score within `pullback` of it, each while kf_rsi has room; left when the trend ends, or beyond it by `buffer` uncertainties."""
    trending, v, z, r = c("trending"), c("kf_velocity"), c("z_score"), c("kf_rsi")
    near = z.between(*pullback)
    up = trending & (v > 0) & (((z > breakout) & (r < rsi[1])) | (near & (r < rsi_back[1])))
    down = trending & (v < 0) & (((z < -breakout) & (r > rsi[0])) | (near & (r > rsi_back[0])))
    margin = buffer * c("kf_uncertainty")
    return _rule(up, down, ~trending | (c("close") < c("kf_trend") - margin), ~trending | (c("close") > c("kf_trend") + margin))


def rule_percentile(df: DataFrame, share: float = 0.05, n: int = 540, least: int = 100, stop: float = 3.0, warmup: int = 540) -> tuple[DataFrame, dict[str, Column]]:
    """df with what the rule reads, and the rule: velocity's z (42 rows) beyond its own upper or lower `share` of n rows while uncertainty is in its lower half; left at the other share, or `stop` deviations of the residual beyond the trend."""
    w42, w180, wn = last_rows(42), last_rows(180), last_rows(n)
    v = c("kf_velocity")
    df = df.withColumns({"_z": F.when(F.count(v).over(w42) >= 5, (v - F.avg(v).over(w42)) / (F.stddev_samp(v).over(w42) + EPS)), "_r": F.log(c("close") / c("kf_trend"))})
    many = F.count("_z").over(wn) >= least
    df = df.withColumns({"_hi": F.when(many, F.percentile("_z", F.lit(1 - share)).over(wn)), "_lo": F.when(many, F.percentile("_z", F.lit(share)).over(wn)), "_sd": F.when(F.count("_r").over(w180) >= 30, F.stddev_samp("_r").over(w180))})
    df = rank_pct(df, "kf_uncertainty", 210, 20)
    sure = (F.coalesce("rank_pct", F.lit(0.5)) < 0.5) & (c("seq") > warmup)
    stop_long, stop_short = F.coalesce(c("_r") < -stop * c("_sd"), F.lit(False)), F.coalesce(c("_r") > stop * c("_sd"), F.lit(False))
    over, under = F.coalesce(c("_z") > c("_hi"), F.lit(False)), F.coalesce(c("_z") < c("_lo"), F.lit(False))
    return df, _rule(over & sure, under & sure, stop_long | under, stop_short | over)
