"""Registered queries of filters, stops, regimes and the ledgers that follow from them, and the same in SQL."""

from __future__ import annotations

import re
import uuid
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import automata as A
from ..operators import filters as K
from ..operators import hmm as H
from ..operators import labels as L
from ..operators import ledgers as T
from ..operators import recurrences as R
from ..operators import regimes as G
from ..operators import rules as U
from ..operators import signals as I
from ..operators import series as S
from ..operators import walkforward as X
from ..operators import windows as W
from ..sources import months as N
from ..streaming import features as V
from ..streaming import trades as Z
from . import catalog as C
from .catalog import BY, RETS, WITH, add_bars, bars, over, r, register, ruled, shown


_ZERO, _ONE = "CAST(0 AS DOUBLE)", "CAST(1 AS DOUBLE)"


def recursive(sql: str) -> str:
    """WITH ... as a recursive one."""
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


# ---- stops ------------------------------------------------------------------------------------


def stopped(b: DataFrame) -> DataFrame:
    """Velocity's side with a trail of two and a hard stop of three deviations; left on a bar of more than two deviations against it, or beyond the average against the move."""
    b = W.returns(b)
    b = b.withColumns({"rv": F.stddev_samp("log_ret").over(W.last_rows(24)), "sma": F.avg("close").over(W.last_rows(20)), "v": F.log(F.col("close") / F.lag("close", 5).over(W.by_seq()))})
    rv, v, ret = F.col("rv"), F.col("v"), F.col("log_ret")
    enter = F.when(v > 0, 1).when(v < 0, -1)
    below, above = F.col("close") < F.col("sma"), F.col("close") > F.col("sma")
    return A.trailing_stop(b, enter, F.when(rv > 0, rv), F.lit(2.0), F.lit(2.0), 3 * rv, 3 * rv, ret < -2 * rv, ret > 2 * rv, below & (v < 0), above & (v > 0))


def stop_sql(inputs: str) -> str:
    """The walk over inputs (symbol, seq, high, low, close, enter, width, kl, ks, ml, ms, bl, bs, ll, ls)."""
    return f"""{inputs},
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 0 AS side, CAST(NULL AS BIGINT) AS entry_seq, {_ZERO} AS ext, {_ZERO} AS trail, {_ZERO} AS hard, {_ZERO} AS k, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS DOUBLE) AS exit_price, CAST(NULL AS BIGINT) AS since FROM i WHERE seq = 1
 UNION ALL
 SELECT symbol, seq, CASE WHEN side <> 0 AND reason IS NOT NULL THEN 0 WHEN side <> 0 THEN side ELSE enter END,
  CASE WHEN side <> 0 AND reason IS NOT NULL THEN NULL WHEN side <> 0 THEN entry_seq WHEN enter <> 0 THEN seq END, ext, trail, hard, k,
  CASE WHEN reason IN ('hard', 'trail') THEN price WHEN reason IS NULL AND (side = 1 OR side = 0 AND enter = 1) THEN greatest(trail, hard) WHEN reason IS NULL AND (side = -1 OR side = 0 AND enter = -1) THEN least(trail, hard) END,
  reason, price, CASE WHEN side <> 0 THEN entry_seq WHEN enter <> 0 THEN seq END
 FROM (SELECT *, CASE reason WHEN 'hard' THEN hard WHEN 'trail' THEN trail END AS price
  FROM (SELECT *, CASE WHEN side = 1 THEN CASE WHEN low < hard THEN 'hard' WHEN low < trail THEN 'trail' WHEN bl THEN 'break' WHEN ll THEN 'signal' END
    WHEN side = -1 THEN CASE WHEN high > hard THEN 'hard' WHEN high > trail THEN 'trail' WHEN bs THEN 'break' WHEN ls THEN 'signal' END END AS reason
   FROM (SELECT *, CASE WHEN width IS NULL THEN CASE WHEN side = 0 THEN hard ELSE trail0 END
      WHEN side = 1 THEN greatest(trail0, ext * exp(-k * width)) WHEN side = -1 THEN least(trail0, ext * exp(k * width))
      WHEN enter = 1 THEN ext * exp(-k * width) ELSE ext * exp(k * width) END AS trail
    FROM (SELECT w.symbol, i.seq, w.side, w.entry_seq, i.high, i.low, i.enter, i.width, i.bl, i.bs, i.ll, i.ls, w.trail AS trail0,
       CASE WHEN w.side = 1 THEN greatest(w.ext, i.high) WHEN w.side = -1 THEN least(w.ext, i.low) WHEN i.enter = 1 THEN i.high ELSE i.low END AS ext,
       CASE WHEN w.side <> 0 THEN w.k WHEN i.enter = 1 THEN i.kl ELSE i.ks END AS k,
       CASE WHEN w.side <> 0 THEN w.hard WHEN i.enter = 1 THEN i.close * exp(-i.ml) ELSE i.close * exp(i.ms) END AS hard
      FROM walk w JOIN i ON i.symbol = w.symbol AND i.seq = w.seq + 1)))))"""


_STOPPED = stop_sql(
    f"""{recursive(RETS)}, s AS (SELECT *, stddev_samp(log_ret) {over(24)} AS rv, avg(close) {over(20)} AS sma, ln(close / lag(close, 5) {BY}) AS v FROM b),
 i AS (SELECT symbol, seq, high, low, close, CASE WHEN rv IS NULL THEN 0 WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END AS enter, nullif(rv, 0) AS width, 2.0 AS kl, 2.0 AS ks, 3 * rv AS ml, 3 * rv AS ms,
  coalesce(log_ret < -2 * rv, false) AS bl, coalesce(log_ret > 2 * rv, false) AS bs, coalesce(close < sma AND v < 0, false) AS ll, coalesce(close > sma AND v > 0, false) AS ls FROM s)"""
)
add_bars(
    "trailing_stop",
    f"{_STOPPED} SELECT symbol, seq, CAST(side AS INTEGER) AS position, since AS entry_seq, {r('stop', 'stop')}, reason, {r('exit_price', 'exit_price')} FROM walk WHERE seq > 0",
    lambda b: shown(stopped(b), "symbol", "seq", "position", "entry_seq", "stop", "reason", "exit_price"),
)
add_bars(
    "trailing_stop_trades",
    f"""{_STOPPED} SELECT x.symbol, x.since AS entry_seq, x.seq AS exit_seq, CAST(e.side AS INTEGER) AS direction, {r('eb.close', 'entry')}, {r('coalesce(x.exit_price, xb.close)', 'leave')}, x.reason, {r('e.side * ln(coalesce(x.exit_price, xb.close) / eb.close)', 'log_return')}
 FROM walk x JOIN walk e ON e.symbol = x.symbol AND e.seq = x.since JOIN bars eb ON eb.symbol = e.symbol AND eb.seq = e.seq JOIN bars xb ON xb.symbol = x.symbol AND xb.seq = x.seq WHERE x.reason IS NOT NULL""",
    lambda b: shown(A.stop_trades(stopped(b)), "symbol", "entry_seq", "exit_seq", "direction", "entry", "leave", "reason", "log_return"),
)
_AHEAD, _BEFORE = over(start="1 FOLLOWING", end="6 FOLLOWING"), over(start="186 PRECEDING", end="7 PRECEDING")
add_bars(
    "win_mae_k",
    f"""{RETS}, w AS (SELECT *, sqrt(avg(pow(ln(high / low), 2)) {over(20)} / {4 * log(2)!r}) AS width FROM b),
 m AS (SELECT symbol, seq, CASE WHEN count(low) {_AHEAD} = 6 THEN ln(open / min(low) {_AHEAD}) END AS l, CASE WHEN count(low) {_AHEAD} = 6 THEN ln(max(high) {_AHEAD} / open) END AS s, CASE WHEN count(width) {_AHEAD} = 6 THEN avg(width) {_AHEAD} END AS a FROM w),
 k AS (SELECT *, CASE WHEN a > 1e-10 THEN l / a END AS kl, CASE WHEN a > 1e-10 THEN s / a END AS ks FROM m)
 SELECT symbol, seq, {", ".join(r(f"CASE WHEN seq > 187 AND count({c}) {_BEFORE} >= 10 THEN quantile_cont({c}, 0.99) {_BEFORE} END", n) for c, n in (("l", "mae_long"), ("s", "mae_short"), ("kl", "k_long"), ("ks", "k_short")))} FROM k""",
    lambda b: shown(K.excursion_multiples(b, F.sqrt(F.avg(F.pow(F.log(F.col("high") / F.col("low")), 2)).over(W.last_rows(20)) / (4 * log(2)))), "symbol", "seq", "mae_long", "mae_short", "k_long", "k_short"),
)

# ---- filters ----------------------------------------------------------------------------------


def filtered(b: DataFrame) -> DataFrame:
    return K.adaptive_filter(b, F.col("duration") / 3600)

# Rolling noise: steps between the known log prices of the last 20 rows, and Parkinson's variance.


def noise_sql(n: int = 20) -> str:
    return f"""m0 AS (SELECT *, (high + low + close) / 3 AS typ, ln((high + low + close) / 3) AS y, duration / 3600 AS dt, pow(ln(high) - ln(low), 2) AS rg FROM bars),
 m1 AS (SELECT *, list(y) {over(n)} AS ys, avg(rg) {over(n)} / {4 * log(2)!r} AS pk FROM m0),
 m AS (SELECT *, CASE WHEN seq = 1 THEN 1.0 ELSE greatest(list_var_pop(list_transform(range(1, len(ys)), lambda j: ys[j + 1] - ys[j])), 1e-8) END AS rt, CASE WHEN seq = 1 THEN 1.0 ELSE greatest(pk, 1e-8) END AS rr FROM m1)"""


def filter2_sql(n: int = 20) -> str:
    """The walk of the two-state filter, and kf with its columns."""
    return f"""{recursive(WITH)}, {noise_sql(n)},
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, y AS x, {_ZERO} AS v, {_ONE} AS p00, {_ZERO} AS p01, {_ONE} AS p11, CAST(NULL AS DOUBLE) AS nis, CAST([] AS DOUBLE[]) AS vs, {_ZERO} AS xp, {_ZERO} AS k0, {_ZERO} AS n00, {_ZERO} AS s, {_ZERO} AS e, {_ZERO} AS boost FROM m WHERE seq = 1
 UNION ALL
 SELECT symbol, seq, xp + k0 * e, v + k1 * e, (1 - k0) * n00, (1 - k0) * n01, n11 - k1 * n01, e * e / s, list_append(vs[greatest(1, len(vs) - {n - 3}) : len(vs)], v + k1 * e), xp, k0, n00, s, e, boost
 FROM (SELECT *, n00 / s AS k0, n01 / s AS k1, y - xp AS e
  FROM (SELECT *, n00 + rt AS s
   FROM (SELECT *, x + dt * v AS xp, p00 + 2 * dt * p01 + dt * dt * p11 + greatest(a * pow(dt, 4) / 4, 1e-10) AS n00, p01 + dt * p11 + greatest(a * pow(dt, 3) / 2, 1e-10) AS n01, p11 + greatest(a * dt * dt, 1e-10) AS n11
    FROM (SELECT *, 0.4 * boost * CASE WHEN len(vs) < 2 THEN 1e-10 ELSE greatest(list_var_pop(vs) * 0.4 * CASE WHEN len(vs) >= 3 THEN 1 + 2 * ((abs(vs[len(vs)] - vs[len(vs) - 1]) + abs(vs[len(vs) - 1] - vs[len(vs) - 2])) / 2) / (list_avg(list_transform(vs, lambda z: abs(z))) + 1e-10) ELSE 1.0 END, 1e-10) END AS a
     FROM (SELECT w.symbol, m.seq, m.y, m.dt, m.rt, w.x, w.v, w.p00, w.p01, w.p11, w.vs, CASE WHEN w.nis IS NULL THEN 1.0 ELSE greatest(1.0, least(3 * w.nis, 20.0)) END AS boost FROM walk w JOIN m ON m.symbol = w.symbol AND m.seq = w.seq + 1)))))),
 kf AS (SELECT m.*, exp(x) AS kf_trend, exp(xp) AS kf_trend_pred, v AS kf_velocity, p11 AS kf_velocity_var, typ - exp(x) AS kf_deviation, (typ - exp(x)) / (exp(x) + 1e-10) * 100 AS kf_deviation_pct, k0 AS kf_gain, p00 AS kf_uncertainty, n00 AS kf_uncertainty_pred,
  s AS kf_innovation_cov, n00 + rr AS kf_innovation_cov_risk, e AS kf_innovation, nis AS kf_nis, boost AS kf_nis_boost, rt AS kf_r_trend, rr AS kf_r_risk, e / (sqrt(s) + 1e-10) AS kf_std_innovation, 3 * sqrt(n00 + rr) AS kf_stop_distance, v / (sqrt(p11) + 1e-10) AS kf_velocity_zscore
  FROM walk JOIN m ON m.symbol = walk.symbol AND m.seq = walk.seq),
 kfs AS (SELECT *, kf_deviation / (CASE WHEN count(*) {over(n)} >= 5 THEN stddev_samp(kf_deviation) {over(n)} END + 1e-10) AS kf_signal FROM kf)"""


FILTER2 = filter2_sql()
add_bars("kalman2", f"{FILTER2} SELECT symbol, seq, {', '.join(r(c, c) for c in K.COLUMNS2)} FROM kfs", lambda b: shown(filtered(b), "symbol", "seq", *K.COLUMNS2))
FILTER3 = f"""{recursive(WITH)}, {noise_sql()},
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, y AS x, {_ZERO} AS v, {_ZERO} AS a, {_ONE} AS p00, {_ZERO} AS p01, {_ZERO} AS p02, {_ONE} AS p11, {_ZERO} AS p12, {_ONE} AS p22, CAST([] AS DOUBLE[]) AS past, {_ZERO} AS gain, {_ZERO} AS e, {_ZERO} AS s FROM m WHERE seq = 1
 UNION ALL
 SELECT symbol, seq, x + n00 / s * e, v + n01 / s * e, a + n02 / s * e, n00 - n00 / s * n00, n01 - n00 / s * n01, n02 - n00 / s * n02, n11 - n01 / s * n01, n12 - n01 / s * n02, n22 - n02 / s * n02,
  list_append(past[greatest(1, len(past) - 18) : len(past)], a + n02 / s * e), n00 / s, e, s
 FROM (SELECT *, n00 + rt AS s, y - x AS e
  FROM (SELECT symbol, seq, y, rt, past, x + v + a / 2 AS x, v + a AS v, a, p00 + 2 * p01 + p02 + p11 + p12 + p22 / 4 + 0.01 * 1e-10 AS n00, p01 + p11 + 1.5 * p12 + p02 + p22 / 2 AS n01, p02 + p12 + p22 / 2 AS n02, p11 + 2 * p12 + p22 + 0.1 * raised AS n11, p12 + p22 AS n12, p22 + raised AS n22
   FROM (SELECT w.*, m.y, m.rt, m.seq AS ns, greatest(1.0, 10 * CASE WHEN len(w.past) > 1 THEN list_var_pop(w.past) ELSE 0.0 END) * 1e-10 AS raised FROM walk w JOIN m ON m.symbol = w.symbol AND m.seq = w.seq + 1) AS q0(symbol, os, x, v, a, p00, p01, p02, p11, p12, p22, past, g0, e0, s0, y, rt, seq, raised)))),
 kf AS (SELECT m.symbol, m.seq, exp(x) AS kf_trend, v AS kf_velocity, a AS kf_acceleration, typ - exp(x) AS kf_deviation, (typ - exp(x)) / (exp(x) + 1e-10) * 100 AS kf_deviation_pct, gain AS kf_gain, p00 AS kf_uncertainty, e AS kf_innovation, e / (sqrt(s) + 1e-10) AS kf_std_innovation FROM walk JOIN m ON m.symbol = walk.symbol AND m.seq = walk.seq)"""
add_bars("kalman3", f"{FILTER3} SELECT symbol, seq, {', '.join(r(c, c) for c in K.COLUMNS3)} FROM kf", lambda b: shown(K.acceleration_filter(b), "symbol", "seq", *K.COLUMNS3))
_DERIVED = ("vel_ma5", "vel_ma20", "vel_diff", "vel_accel", "vel_z", "dev_z")
add_bars(
    "win_kf_derived",
    f"""{FILTER2}, d AS (SELECT *, avg(kf_velocity) {over(5)} AS vel_ma5, avg(kf_velocity) {over(20)} AS vel_ma20, avg(kf_velocity) {over(5)} - avg(kf_velocity) {over(20)} AS vel_diff, kf_velocity - lag(kf_velocity, 5) {BY} AS vel_accel, CASE WHEN count(*) {over(42)} >= 5 THEN (kf_velocity - avg(kf_velocity) {over(42)}) / (stddev_samp(kf_velocity) {over(42)} + 1e-10) END AS vel_z, ln(close / kf_trend) AS gap FROM kf),
 f AS (SELECT *, (gap - avg(gap) {over(50)}) / (stddev_samp(gap) {over(50)} + 1e-10) AS dev_z, lag(vel_diff) {BY} AS pd FROM d) SELECT symbol, seq, {", ".join(r(c, c) for c in _DERIVED)}, CASE WHEN vel_diff > 0 AND pd <= 0 THEN 1 WHEN vel_diff < 0 AND pd >= 0 THEN -1 ELSE 0 END AS vel_cross FROM f""",
    lambda b: shown(K.derived(filtered(b)), "symbol", "seq", *_DERIVED, "vel_cross"),
)
_HYBRID = f"""{FILTER2}, h0 AS (SELECT *, coalesce(ln(close / lag(close) {BY}), 0.0) AS lr FROM kf), h1 AS (SELECT *, CASE WHEN count(*) {over(42)} >= 10 THEN greatest(sqrt(kf_uncertainty), stddev_samp(lr) {over(42)}) END AS sigma_hybrid FROM h0),
 h AS (SELECT *, CASE WHEN count(sigma_hybrid) {over(120)} >= 30 THEN sigma_hybrid / (avg(sigma_hybrid) {over(120)} + 1e-10) END AS v_ratio FROM h1)"""
add_bars("win_sigma_hybrid", f"{_HYBRID} SELECT symbol, seq, {r('sigma_hybrid', 'sigma_hybrid')}, {r('v_ratio', 'v_ratio')} FROM h", lambda b: shown(K.hybrid_volatility(filtered(b)), "symbol", "seq", "sigma_hybrid", "v_ratio"))
_DUAL = ("fast_velocity", "fast_zscore", "fast_uncertainty", "slow_velocity", "slow_zscore", "slow_uncertainty", "spread", "spread_std", "kf_innovation_cov_risk")


def named_apart(sql: str, suffix: str, names: tuple[str, ...]) -> str:
    """The tables of a walk under other names, so that two stand in one query."""
    for name in names:
        sql = re.sub(rf"\b{name}\b(?! AS \w+ FROM walk)", f"{name}_{suffix}", sql)
    return sql


_SLOW = named_apart(filter2_sql(120).partition(", m0 AS")[2], "s", ("walk", "m0", "m1", "m", "kf", "kfs"))
_DUALS = f"""{FILTER2}, m0_s AS{_SLOW}, d0 AS (SELECT f.*, f.kf_velocity AS fast_velocity, f.kf_velocity_zscore AS fast_zscore, f.kf_uncertainty AS fast_uncertainty, s.kf_velocity AS slow_velocity, s.kf_velocity_zscore AS slow_zscore, s.kf_uncertainty AS slow_uncertainty, f.kf_velocity - s.kf_velocity AS spread FROM kf f JOIN kf_s s ON s.symbol = f.symbol AND s.seq = f.seq),
 d AS (SELECT *, CASE WHEN count(*) {over(50)} >= 10 THEN stddev_samp(spread) {over(50)} END AS spread_std FROM d0)"""
add_bars("kalman_dual", f"{_DUALS} SELECT symbol, seq, {', '.join(r(c, c) for c in _DUAL)} FROM d", lambda b: shown(K.dual_filter(b, F.col("duration") / 3600), "symbol", "seq", *_DUAL))


def named_signals(b: DataFrame) -> DataFrame:
    """The filters' columns with each named signal, by the average duration of 50 bars (10 at least) and the lower quartile of ticks of 100."""
    b = K.dual_filter(b, F.col("duration") / 3600)
    w50, w100 = W.last_rows(50), W.last_rows(100)
    b = b.withColumns({"duration_ma": F.when(F.count("duration").over(w50) >= 10, F.avg("duration").over(w50)), "tick_p25": F.percentile("ticks", F.lit(0.25)).over(w100)})
    return b.withColumns({f"long_{n}": x for n, x in U.long_signals(1.0, 0.5, 1.0).items()} | {f"short_{n}": x for n, x in U.short_signals(1.0, 1.0).items()})


_LONGS = {"VelVolume": "a AND d", "TrendAlign": "a AND u", "FastOnly": "a", "SlowZ": "h", "VelTrend": "a AND d AND u", "VelSlow": "a AND d AND h", "AllThree": "a AND d AND u", "OR_VelTrend": "a AND d OR a AND u", "OR_VelSlow": "a AND d OR h", "OR_FastSlow": "a OR h", "OR_All": "a AND d OR a AND u OR h"}
_SHORTS = {"Spread": "z AND spread < -spread_std", "SpreadTight": "z AND spread < -1.5 * spread_std", "SlowTick": "slow_zscore < -1 AND ticks < p25", "FastOnly": "z"}
_NAMED = f"""{_DUALS}, n AS (SELECT *, CASE WHEN count(*) {over(50)} >= 10 THEN avg(duration) {over(50)} END AS dma, quantile_cont(ticks, 0.25) {over(100)} AS p25 FROM d),
 g AS (SELECT *, fast_zscore > 1 AS a, slow_zscore > 0.5 AS u, slow_zscore > 1 AS h, coalesce(duration < 0.5 * dma, false) AS d, dma IS NOT NULL AS ok, fast_zscore < -1 AS z FROM n)"""
add_bars("rule_long_11", f"""{_NAMED} SELECT symbol, seq, {", ".join(f'coalesce(ok AND ({x}), false) AS "{n}"' for n, x in _LONGS.items())} FROM g""", lambda b: named_signals(b).select("symbol", "seq", *[F.col(f"long_{n}").alias(n) for n in _LONGS]))
add_bars("rule_short_4", f"""{_NAMED} SELECT symbol, seq, {", ".join(f'coalesce({x}, false) AS "{n}"' for n, x in _SHORTS.items())} FROM g""", lambda b: named_signals(b).select("symbol", "seq", *[F.col(f"short_{n}").alias(n) for n in _SHORTS]))


def velocity_rule(b: DataFrame, k: float = 2.5, entry_z: float = 2.0, quiet: float = 4.0, risk: float = 0.03) -> DataFrame:
    """Always in the market by the sign of the filter's velocity, with ratcheted and hard stops from past adverse moves, left on an innovation against it while volatility is above its mean, or on velocity's z while it is below."""
    b = K.hybrid_volatility(filtered(W.averages(b)))
    width = F.sqrt("kf_innovation_cov_risk")
    b = K.excursion_multiples(b, width)
    w42, w180 = W.last_rows(42), W.last_rows(180)
    b = b.withColumns({"gap": F.log(F.col("close") / F.col("kf_trend")), "vz": F.when(F.count("*").over(w42) >= 5, (F.col("kf_velocity") - F.avg("kf_velocity").over(w42)) / (F.stddev_samp("kf_velocity").over(w42) + 1e-10))})
    everywhere = b.groupBy("symbol").agg(F.greatest(F.stddev_pop("gap"), F.lit(1e-10)).alias("all_sd"))
    b = b.join(everywhere, "symbol").withColumn("sd", F.coalesce(F.when(F.count("gap").over(w180) >= 30, F.stddev_samp("gap").over(w180)), F.col("all_sd")))
    b = W.rank_pct(b, "kf_uncertainty", 210, 20)
    unsure = F.coalesce("rank_pct", F.lit(0.5))
    wild, calm = F.col("v_ratio") >= 1, (F.col("v_ratio") < 1) & (F.col("intensity") < quiet)
    times = F.greatest(F.lit(1.5), F.least(F.lit(4.0), k / (F.col("v_ratio") + 1e-10)))
    scaled = 4.0 * F.exp(-unsure * unsure / (2 * 0.5 * 0.5))
    size = lambda mae: F.greatest(F.lit(0.1), F.least(F.lit(3.0), risk / (mae + 1e-10) * scaled))
    late = F.row_number().over(W.by_seq()) > 210
    enter = F.when(late & (F.col("kf_velocity") > 0), 1).when(late & (F.col("kf_velocity") < 0), -1)
    return A.trailing_stop(
        b, enter, width, F.col("k_long"), F.col("k_short"), F.col("mae_long"), F.col("mae_short"),
        wild & (F.col("gap") < -times * F.col("sd")), wild & (F.col("gap") > times * F.col("sd")), calm & (F.col("vz") < -entry_z), calm & (F.col("vz") > entry_z),
        size(1 - F.exp(-F.col("mae_long"))), size(F.exp("mae_short") - 1),
    )


add_bars("rule_velocity", None, lambda b: shown(velocity_rule(b), "symbol", "seq", "position", "entry_seq", "stop", "used_k", "size", "reason", "exit_price"))

# ---- regimes ----------------------------------------------------------------------------------

_MODE = ("close > 1.01 * sma", "close < 0.99 * sma")
add_bars(
    "mode_switch",
    f"""{recursive(WITH)}, s AS (SELECT *, avg(close) {over(20)} AS sma FROM bars), f AS (SELECT symbol, seq, CASE WHEN {_MODE[0]} THEN 'momentum' WHEN {_MODE[1]} THEN 'reversal' ELSE 'neutral' END AS mode, 0.5 + 0.5 * abs(close - open) / nullif(high - low, 0) AS p FROM s),
 walk AS (SELECT symbol, seq, mode AS now, seq AS last, true AS sw, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS BIGINT) AS since, p FROM f WHERE seq = 1 UNION ALL
  SELECT symbol, seq, CASE WHEN sw THEN mode ELSE now END, CASE WHEN sw THEN seq ELSE last END, sw, CASE WHEN sw THEN now END, CASE WHEN sw THEN seq - last END, p
  FROM (SELECT f.*, w.now, w.last, coalesce(f.mode <> w.now AND f.p >= 0.6 AND f.seq - w.last >= 5, false) AS sw FROM walk w JOIN f ON f.symbol = w.symbol AND f.seq = w.seq + 1))
 SELECT symbol, seq, was AS from_mode, now AS to_mode, since AS bars_since, {r('p', 'probability')} FROM walk WHERE sw""",
    lambda b: shown(
        A.mode_switch(
            b.withColumn("sma", F.avg("close").over(W.last_rows(20))),
            F.when(F.expr(_MODE[0]), "momentum").when(F.expr(_MODE[1]), "reversal").otherwise("neutral"),
            0.5 + 0.5 * F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)),
        ),
        "symbol", "seq", "from_mode", "to_mode", "bars_since", "probability",
    ),
)
_COMBO = f"""{recursive(C._RULED)}, z AS (SELECT symbol, seq, close, tr, sk, coalesce(sk < 20, false) AS os, coalesce(sk > 80, false) AS ob, tp, coalesce(pc, close) AS pc, u, v FROM v),
 f AS (SELECT *, NOT os AND NOT ob AND tp > pc + sqrt(u) AND v > 0 AS tl, NOT os AND NOT ob AND tp < pc - sqrt(u) AND v < 0 AS ts, os AND tp > pc AS ml, ob AND tp < pc AS ms FROM z),
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 0 AS s FROM f WHERE seq = 1 UNION ALL
  SELECT f.symbol, f.seq, CASE WHEN w.s = 0 AND ml THEN 3 WHEN w.s = 0 AND tl THEN 1 WHEN w.s IN (0, 1, 3) AND ms THEN 4 WHEN w.s IN (0, 1, 3) AND ts THEN 2 WHEN w.s IN (2, 4) AND ml THEN 3 WHEN w.s IN (2, 4) AND tl THEN 1
   WHEN w.s = 1 AND close < tr OR w.s = 2 AND close > tr OR w.s = 3 AND sk > 50 OR w.s = 4 AND sk < 50 THEN 0 ELSE w.s END FROM walk w JOIN f ON f.symbol = w.symbol AND f.seq = w.seq + 1)"""
add_bars(
    "rule_osc_combo",
    f"{_COMBO} SELECT symbol, seq, CAST(CASE WHEN s IN (1, 3) THEN 1 WHEN s IN (2, 4) THEN -1 ELSE 0 END AS INTEGER) AS position, CASE WHEN s IN (1, 2) THEN 'trend' WHEN s IN (3, 4) THEN 'fade' END AS entry_type FROM walk WHERE seq > 0",
    lambda b: U.osc_combo(ruled(b)).select("symbol", "seq", "position", "entry_type"),
)
HMM_COLUMNS = ["x1", "x2"]


def _fitted(spark, d) -> tuple[DataFrame, H.Model]:
    rows = H.standardised(C.M.bars(spark, d)).persist()
    return rows, H.fit(rows, HMM_COLUMNS)


register("hmm_fit")(lambda spark, d: shown(H.parameters(spark, _fitted(spark, d)[1]), "state", "name", "pi", "log_likelihood", "iterations", *[F.round(F.element_at("means", i + 1), 6).alias(f"mean_{c}") for i, c in enumerate(HMM_COLUMNS)], *[F.round(F.element_at("moves", i + 1), 6).alias(f"to_{i}") for i in range(3)]))


def _decoded(spark, d) -> DataFrame:
    rows, model = _fitted(spark, d)
    names = F.array(*[F.lit(n) for n in model.names()])
    found = H.decode(rows, HMM_COLUMNS, model)
    return shown(found, "symbol", "seq", *[F.element_at(names, F.col(c) + 1).alias(c) for c in ("filtered", "smoothed", "path")], "p_filtered", "p_smoothed")


register("hmm_decode")(_decoded)
add_bars(
    "hmm_stationary",
    f"""{C._SP}, t AS (SELECT symbol, f AS g, lag(f) {BY} AS a FROM s), n AS (SELECT symbol, count(*) FILTER (a = 0 AND g = 1) * 1.0 / count(*) FILTER (a = 0) AS up, count(*) FILTER (a = 1 AND g = 0) * 1.0 / count(*) FILTER (a = 1) AS down FROM t WHERE a IS NOT NULL GROUP BY 1),
 x AS (SELECT symbol, unnest([0, 1]) AS state, up, down FROM n) SELECT symbol, CAST(state AS INTEGER) AS state, {r('CASE WHEN state = 1 THEN up / (up + down) ELSE down / (up + down) END', 'share')} FROM x""",
    lambda b: shown(H.stationary(G.transitions(b.withColumn("f", (F.col("close") > F.col("open")).cast("int")), "f")), "symbol", "state", "share"),
)

# ---- whole series -----------------------------------------------------------------------------

_XS = f"""{RETS}, x AS (SELECT symbol, log_ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS pos FROM b WHERE log_ret IS NOT NULL), c AS (SELECT symbol, count(*) AS n, avg(x) AS mean FROM x GROUP BY 1),
 sc AS (SELECT symbol, n, mean, unnest(list_distinct(list_concat([CAST(10 AS BIGINT), CAST(n // 4 AS BIGINT)], list_transform(range(1, 19), lambda i: CAST(floor(10 * pow((n // 4) / 10.0, i / 19.0)) AS BIGINT))))) AS scale FROM c WHERE n >= 20)"""
_SLOPE = f"""l AS (SELECT symbol, ln(scale) AS lx, ln(value) AS ly FROM pts WHERE value > 0), k AS (SELECT symbol, count(*) AS k, regr_slope(ly, lx) AS h, regr_r2(ly, lx) AS r2 FROM l GROUP BY 1),
 o AS (SELECT c.symbol, CASE WHEN k >= 3 THEN least(1.0, greatest(0.0, h)) ELSE 0.5 END AS hurst, CASE WHEN k >= 3 THEN r2 ELSE 0.0 END AS r2, CAST(coalesce(k, 0) AS INTEGER) AS scales FROM c LEFT JOIN k ON k.symbol = c.symbol)
 SELECT symbol, {r('hurst', 'hurst')}, {r('r2', 'r2')}, scales, CASE WHEN hurst > 0.55 THEN 'trending' WHEN hurst < 0.45 THEN 'mean_reverting' ELSE 'random_walk' END AS regime FROM o"""
_HURST = ("symbol", "hurst", "r2", "scales", "regime")
add_bars(
    "win_hurst_scales",
    f"""{_XS}, j AS (SELECT x.symbol, scale, pos // scale AS sg, pos, x FROM x JOIN sc ON sc.symbol = x.symbol WHERE scale >= 2 AND pos < scale * (n // scale)), m AS (SELECT symbol, scale, sg, avg(x) AS m, stddev_samp(x) AS s FROM j GROUP BY 1, 2, 3),
 w AS (SELECT j.symbol, j.scale, j.sg, s, sum(x - m) OVER (PARTITION BY j.symbol, j.scale, j.sg ORDER BY pos) AS walk FROM j JOIN m ON m.symbol = j.symbol AND m.scale = j.scale AND m.sg = j.sg),
 seg AS (SELECT symbol, scale, sg, (max(walk) - min(walk)) / any_value(s) AS rs FROM w WHERE s > 1e-10 GROUP BY 1, 2, 3), pts AS (SELECT symbol, scale, avg(rs) AS value FROM seg GROUP BY 1, 2), {_SLOPE}""",
    lambda b: shown(S.hurst_scales(W.returns(b), "log_ret"), *_HURST),
)
add_bars(
    "win_hurst_dfa",
    f"""{_XS}, p AS (SELECT x.symbol, pos, sum(x - mean) OVER (PARTITION BY x.symbol ORDER BY pos) AS y FROM x JOIN c ON c.symbol = x.symbol),
 j AS (SELECT p.symbol, scale, d AS side, CASE WHEN d = 0 THEN pos // scale ELSE (n - 1 - pos) // scale END AS sg, n, pos, y FROM p JOIN sc ON sc.symbol = p.symbol, (SELECT unnest([0, 1]) AS d) z WHERE scale >= 3),
 seg AS (SELECT symbol, scale, side, sg, greatest(regr_syy(y, pos) - pow(regr_sxy(y, pos), 2) / regr_sxx(y, pos), 0) / scale AS f2 FROM j WHERE sg < n // scale GROUP BY 1, 2, 3, 4), pts AS (SELECT symbol, scale, sqrt(avg(f2)) AS value FROM seg GROUP BY 1, 2), {_SLOPE}""",
    lambda b: shown(S.hurst_dfa(W.returns(b), "log_ret"), *_HURST),
)
add_bars(
    "agg_adf",
    f"""{WITH}, d AS (SELECT symbol, seq, lag(close) {BY} AS u, close - lag(close) {BY} AS z, count(*) OVER (PARTITION BY symbol) AS v FROM bars), e AS (SELECT *, lag(z) {BY} AS w FROM d),
 m AS (SELECT symbol, any_value(v) AS v, count(*) AS n, var_pop(u) AS uu, var_pop(w) AS ww, var_pop(z) AS zz, covar_pop(u, w) AS uw, covar_pop(u, z) AS uz, covar_pop(w, z) AS wz FROM e WHERE w IS NOT NULL GROUP BY 1),
 q AS (SELECT *, (uz * ww - wz * uw) / (uu * ww - uw * uw) AS b, (wz * uu - uz * uw) / (uu * ww - uw * uw) AS c FROM m),
 t AS (SELECT symbol, v, CASE WHEN v >= 20 THEN b / sqrt(n * (zz - b * uz - c * wz) / (n - 3) * ww / (n * (uu * ww - uw * uw))) END AS t FROM q)
 SELECT symbol, {r('t', 'adf_statistic')}, greatest(v - 2, 0) AS n_obs, coalesce(t < {S.ADF_CRITICAL[1]}, false) AS stationary FROM t""",
    lambda b: shown(S.adf(b, "close"), "symbol", "adf_statistic", "n_obs", "stationary"),
)


def bubbles(b: DataFrame) -> DataFrame:
    """Fits at the end of each day of hourly bars, windows of 120 bars up to all that a symbol has, in steps of 60."""
    return S.fit_filters(S.bubble_fits(b, windows=tuple(range(120, 751, 60))))


add_bars("fit_filters", None, lambda b: shown(bubbles(b), "symbol", "end", "window", "ahead", "m", "omega", "r2", "damping", "oscillations", F.array_join("failed", ",").alias("failed"), "passed", "quality"))
add_bars("bubble_scan", None, lambda b: shown(S.bubble_confidence(bubbles(b)), "symbol", "end", "windows", "confidence", "tc_mean", "tc_std", "tc_median"))

# ---- ledgers ----------------------------------------------------------------------------------


def banded(b: DataFrame) -> DataFrame:
    """A signal where the close is 2 % beyond its average, none between, and a stop 3 % beyond the average on the far side."""
    b = b.withColumn("sma", F.avg("close").over(W.last_rows(20)))
    sig = F.when(F.col("close") > 1.02 * F.col("sma"), 1).when(F.col("close") < 0.98 * F.col("sma"), -1).otherwise(0)
    return b.withColumn("sig", sig).withColumn("stop", F.when(F.col("sig") == 1, 0.97 * F.col("sma")).when(F.col("sig") == -1, 1.03 * F.col("sma")).otherwise(0.0))


_BAND = f"""{WITH}, a AS (SELECT *, avg(close) {over(20)} AS sma FROM bars), g0 AS (SELECT *, CASE WHEN close > 1.02 * sma THEN 1 WHEN close < 0.98 * sma THEN -1 ELSE 0 END AS sig FROM a),
 g AS (SELECT *, CASE sig WHEN 1 THEN 0.97 * sma WHEN -1 THEN 1.03 * sma ELSE 0.0 END AS stop, coalesce(lag(sig) {BY}, 0) AS bf FROM g0)"""
_PRICED = "symbol, entry_seq, exit_seq, CAST(direction AS INTEGER) AS direction, ep * (1 + direction * 0.0005) AS entry_price, xp * (1 - direction * 0.0005) AS exit_price, reason, exit_seq - entry_seq AS holding_bars"
_LEDGER = ("symbol", "entry_seq", "exit_seq", "direction", "entry_price", "exit_price", "reason", "pnl", "holding_bars")
_LEDGER_SQL = f"symbol, entry_seq, exit_seq, direction, {r('entry_price', 'entry_price')}, {r('exit_price', 'exit_price')}, reason, {r('direction * (exit_price - entry_price) / entry_price - 0.0008', 'pnl')}, holding_bars"
add_bars(
    "led_exit_signal",
    f"""{_BAND}, h AS (SELECT *, max(CASE WHEN bf <> 0 THEN seq END) {over(start='UNBOUNDED PRECEDING', end='1 PRECEDING')} AS ps FROM g), t AS (SELECT h.*, p.bf AS pb FROM h LEFT JOIN h p ON p.symbol = h.symbol AND p.seq = h.ps),
 e AS (SELECT symbol, seq AS entry_seq, bf AS direction, open AS ep FROM t WHERE bf <> 0 AND coalesce(pb, 0) <> bf), x AS (SELECT e.symbol, entry_seq, direction, ep, min(t.seq) AS exit_seq FROM e JOIN g t ON t.symbol = e.symbol AND t.seq > entry_seq AND t.bf = -direction GROUP BY ALL),
 l AS (SELECT {_PRICED} FROM (SELECT x.*, g.open AS xp, 'signal' AS reason FROM x JOIN g ON g.symbol = x.symbol AND g.seq = x.exit_seq)) SELECT {_LEDGER_SQL} FROM l""",
    lambda b: shown(T.signal_trades(T.signal_candidates(banded(b), "sig", F.lit(0.0005))), *_LEDGER),
)
add_bars(
    "led_exit_stop",
    f"""{recursive(_BAND)}, o AS (SELECT *, stop > 0 AND low <= stop AS hl, stop > 0 AND high >= stop AS hs FROM g),
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 0 AS side, CAST(NULL AS BIGINT) AS since, CAST(NULL AS DOUBLE) AS ep, 0 AS was, CAST(NULL AS DOUBLE) AS xp, CAST(NULL AS VARCHAR) AS why, CAST(NULL AS BIGINT) AS began, CAST(NULL AS DOUBLE) AS paid, false AS pend FROM o WHERE seq = 1
 UNION ALL
 SELECT symbol, seq, CASE WHEN why IS NOT NULL THEN 0 WHEN side <> 0 THEN side WHEN pend THEN bf ELSE 0 END, CASE WHEN why IS NULL AND side <> 0 THEN since WHEN side = 0 AND pend THEN seq END, CASE WHEN why IS NULL AND side <> 0 THEN ep WHEN side = 0 AND pend THEN CAST(open AS DOUBLE) END,
  side, CASE why WHEN 'sl' THEN stop WHEN 'signal' THEN CASE WHEN stop > 0 AND stop < 1e17 THEN stop ELSE open END END, why, since, ep, (why IS NOT NULL OR (side = 0 AND NOT pend)) AND sig <> 0
 FROM (SELECT w.symbol, o.seq, w.side, w.since, w.ep, w.pend, o.bf, o.open, o.stop, o.sig, CASE WHEN w.side = 0 THEN NULL WHEN w.side = 1 AND hl OR w.side = -1 AND hs THEN 'sl' WHEN o.bf <> w.side THEN 'signal' END AS why FROM walk w JOIN o ON o.symbol = w.symbol AND o.seq = w.seq + 1)),
 l AS (SELECT {_PRICED} FROM (SELECT symbol, began AS entry_seq, seq AS exit_seq, was AS direction, paid AS ep, xp, why AS reason FROM walk WHERE why IS NOT NULL)) SELECT {_LEDGER_SQL} FROM l""",
    lambda b: shown(T.stop_trades(T.stop_candidates(banded(b), "sig", "stop", F.lit(0.0005))), *_LEDGER),
)
KELLY_WINDOW = 200  # the given events make 720 hourly bars a symbol
add_bars(
    "kelly_size",
    f"""{_BAND}, u0 AS (SELECT *, coalesce(var_samp(close) {over(20)}, 1.0) AS u FROM g), i AS (SELECT symbol, seq FROM u0 WHERE seq > {KELLY_WINDOW}),
 w AS (SELECT i.symbol, i.seq AS ti, k.seq, k.close, k.sig, CASE WHEN k.seq = i.seq - {KELLY_WINDOW} THEN 0 ELSE k.bf END AS bf FROM i JOIN u0 k ON k.symbol = i.symbol AND k.seq >= i.seq - {KELLY_WINDOW} AND k.seq < i.seq),
 o AS (SELECT *, max(CASE WHEN sig <> 0 AND sig <> bf THEN seq END) OVER (PARTITION BY symbol, ti ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM w),
 tr AS (SELECT o.symbol, o.ti, o.bf * (o.close - e.close) / e.close AS r FROM o JOIN u0 e ON e.symbol = o.symbol AND e.seq = o.st WHERE o.bf <> 0 AND o.sig <> o.bf),
 n AS (SELECT symbol, ti, count(*) AS n, count(*) FILTER (r > 0) AS nw, count(*) FILTER (r < 0) AS nl, avg(r) FILTER (r > 0) AS aw, -avg(r) FILTER (r < 0) AS al FROM tr GROUP BY 1, 2),
 s AS (SELECT u0.symbol, u0.seq, CASE WHEN u0.seq > {KELLY_WINDOW} THEN coalesce(n, 0) END AS n, nw, nl, nw * 1.0 / n AS rate, aw / (al + 1e-10) AS pay, avg(u) OVER (PARTITION BY u0.symbol ORDER BY u0.seq ROWS BETWEEN 100 PRECEDING AND CURRENT ROW) / (u + 1e-10) AS pr FROM u0 LEFT JOIN n ON n.symbol = u0.symbol AND n.ti = u0.seq),
 f AS (SELECT *, coalesce(n >= 5 AND nw > 0 AND nl > 0, false) AS ok FROM s), k AS (SELECT *, CASE WHEN ok THEN least(1.0, greatest(0.0, rate - (1 - rate) / (pay + 1e-10))) / 2 ELSE 0.25 END AS raw FROM f)
 SELECT symbol, seq, n AS kelly_trades, {r('CASE WHEN ok THEN rate END', 'kelly_win_rate')}, {r('CASE WHEN ok THEN pay END', 'kelly_payoff')}, {r(f'CASE WHEN seq > {KELLY_WINDOW} THEN least(3.0, greatest(0.1, 0.1 + 2.9 * raw * least(2.0, greatest(0.5, pr)))) ELSE 1.55 END', 'kelly_size')} FROM k""",
    lambda b: shown(T.kelly_size(banded(b).withColumn("u", F.coalesce(F.var_samp("close").over(W.last_rows(20)), F.lit(1.0))), "sig", "u", KELLY_WINDOW), "symbol", "seq", "kelly_trades", "kelly_win_rate", "kelly_payoff", "kelly_size"),
)

# ---- streams and increments -------------------------------------------------------------------


def streamed(spark, d) -> DataFrame:
    return Z.drained(V.bar_features(Z.read_events(spark, f"{d}/events.parquet")))


# the bars of dollar_bars, but for each symbol's open one
_CLOSED = f"""{C.ORACLE_SQL["dollar_bars"].partition("SELECT symbol, bar_id, min(ts_ms) AS start_time")[0]},
 nb0 AS (SELECT symbol, CAST(bar_id AS BIGINT) AS bar_no, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, trade_id) AS close, sum(qty) AS volume, sum(quote_qty) AS dollar_value, count(*) AS tick_count, arg_max(threshold, trade_id) AS threshold FROM ids GROUP BY 1, 2),
 nb AS (SELECT * FROM nb0 WHERE dollar_value >= threshold - 1e-9)"""
_STREAM = ("open", "high", "low", "close", "volume", "dollar_value", "threshold")
register("st_bars", f"{_CLOSED} SELECT symbol, bar_no, {', '.join(r(c, c) for c in _STREAM)}, tick_count FROM nb")(lambda spark, d: shown(streamed(spark, d), "symbol", "bar_no", *_STREAM, "tick_count"))
_FEATURES = ("close", "log_ret", "ewm_z", "exp_z", "roll_vol", "momentum")
_A = 1 - 0.5 ** (1 / V.HALFLIFE)
_BN = "OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
register(
    "st_features",
    f"""{_CLOSED}, lr AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_no)) AS log_ret, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY bar_no) - 1 AS m20,
  count(*) {_BN.format("UNBOUNDED")} AS n, avg(close) {_BN.format("UNBOUNDED")} AS am, coalesce(stddev_samp(close) {_BN.format("UNBOUNDED")}, 0) AS asd FROM nb),
 vo AS (SELECT *, stddev_samp(log_ret) {_BN.format(23)} AS roll_vol FROM lr),
 ew AS (SELECT symbol, bar_no, close, close AS mean, {_ZERO} AS var FROM vo WHERE n = 1 UNION ALL
  SELECT v.symbol, v.bar_no, v.close, {_A!r} * v.close + {1 - _A!r} * e.mean, {1 - _A!r} * (e.var + {_A!r} * pow(v.close - e.mean, 2)) FROM ew e JOIN vo v ON v.symbol = e.symbol AND v.bar_no = e.bar_no + 1),
 o AS (SELECT vo.symbol, vo.bar_no, vo.close, log_ret, roll_vol, m20 AS momentum, CASE WHEN n < 2 OR asd < 1e-10 THEN 0.0 ELSE (vo.close - am) / asd END AS exp_z, 5 * (1 - 2 / (exp(2 * CASE WHEN sqrt(var) < 1e-10 THEN 0.0 ELSE (vo.close - mean) / sqrt(var) / 5 END) + 1)) AS ewm_z FROM vo JOIN ew ON ew.symbol = vo.symbol AND ew.bar_no = vo.bar_no)
 SELECT symbol, bar_no, {", ".join(r(c, c) for c in _FEATURES)} FROM o""",
)(lambda spark, d: shown(streamed(spark, d), "symbol", "bar_no", *_FEATURES))


def incremental(spark, d) -> DataFrame:
    """Hourly bars by month in three runs: the trades of the first 20 days, all trades, and all trades again; the commits after them."""
    trades = C.M.trades(spark, d)
    path = f"{Z.shared(spark)}/months-{uuid.uuid4().hex}"
    first = trades.agg(F.min("ts")).first()[0]
    for source in (trades.where(F.col("ts") < F.lit(first) + F.expr("INTERVAL 20 DAYS")), trades, trades):
        N.write_new_months(source, path, C.M.bars_of, later=1)
    return N.commits(spark, path)


register(
    "snk_idempotent",
    f"""WITH {C.M.BARS_SQL}, f AS (SELECT min(ts) AS f FROM trades), mo AS (SELECT symbol, strftime(ts, '%Y-%m') AS ym, count(*) AS source_rows, count(*) FILTER (ts < f + INTERVAL 20 DAY) AS early, count(DISTINCT date_trunc('hour', ts)) AS n_rows FROM trades, f GROUP BY 1, 2),
 c AS (SELECT *, count(*) OVER w AS newer, count(CASE WHEN early > 0 THEN 1 END) OVER w AS newer1 FROM mo WINDOW w AS (PARTITION BY symbol ORDER BY ym DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT symbol, ym, n_rows, source_rows, newer >= 1 AS complete, CAST(CASE WHEN early > 0 AND (newer1 >= 1 OR early = source_rows AND newer = 0) THEN 1 ELSE 2 END AS BIGINT) AS run FROM c""",
)(lambda spark, d: incremental(spark, d).select("symbol", "ym", "n_rows", "source_rows", "complete", "run"))

# ---- walk-forward -----------------------------------------------------------------------------

GRID = [{"entry": e, "leave": x} for e in (0.5, 1.0, 1.5, 2.0) for x in (0.0, 0.5)]


def walked(b: DataFrame) -> DataFrame:
    """Folds of 10 days of training and 5 of test, every 5 days, of a rule on the z of the close."""
    b = W.zscore(b, "close", 20)
    folds = L.rolling_folds(b.select("symbol", F.to_date("bar_ts").alias("day")), 10, 5, 5)
    return X.walk_forward(X.band_results(X.gridded(b, GRID), "z"), folds, ["entry", "leave"])


_GRID = ", ".join(f"({g['entry']}, {g['leave']})" for g in GRID)
_WALKED = f"""{recursive(WITH)}, zz AS (SELECT symbol, seq, bar_ts, close, coalesce(close / lag(close) {BY} - 1, 0.0) AS ret, coalesce(CASE WHEN count(*) {over(20)} >= 20 THEN (close - avg(close) {over(20)}) / (stddev_samp(close) {over(20)} + 1e-10) END, 0.0) AS z FROM bars),
 gr AS (SELECT CAST(e AS DOUBLE) AS entry, CAST(x AS DOUBLE) AS leave FROM (VALUES {_GRID}) t(e, x)),
 walk AS (SELECT symbol, entry, leave, CAST(0 AS BIGINT) AS seq, 0 AS p FROM zz, gr WHERE seq = 1 UNION ALL
  SELECT w.symbol, w.entry, w.leave, k.seq, CASE WHEN w.p = 1 THEN CASE WHEN z < w.leave THEN 0 ELSE 1 END WHEN w.p = -1 THEN CASE WHEN z > -w.leave THEN 0 ELSE -1 END WHEN z > w.entry THEN 1 WHEN z < -w.entry THEN -1 ELSE 0 END FROM walk w JOIN zz k ON k.symbol = w.symbol AND k.seq = w.seq + 1),
 ps AS (SELECT w.symbol, entry, leave, CAST(bar_ts AS DATE) AS day, p, lag(p) OVER (PARTITION BY w.symbol, entry, leave ORDER BY w.seq) AS q, ret FROM walk w JOIN zz ON zz.symbol = w.symbol AND zz.seq = w.seq),
 dl AS (SELECT symbol, entry, leave, day, sum(coalesce(q, 0) * ret - 0.0004 * abs(p - coalesce(q, 0))) AS pnl, count(*) FILTER (p <> coalesce(q, 0) AND p <> 0) AS trades FROM ps GROUP BY 1, 2, 3, 4),
 en AS (SELECT symbol, min(day) AS a, max(day) AS b FROM dl GROUP BY 1), fo AS (SELECT symbol, a, unnest(range(0, CAST(floor((date_diff('day', a, b) + 1 - 15) / 5.0) AS BIGINT) + 1)) AS fold FROM en),
 me AS (SELECT dl.*, fold, day >= a + CAST(fold * 5 + 10 AS INTEGER) AS test FROM dl JOIN fo ON fo.symbol = dl.symbol AND day >= a + CAST(fold * 5 AS INTEGER) AND day < a + CAST(fold * 5 + 15 AS INTEGER)),
 sm AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol, fold, entry, leave, test ORDER BY day) AS s FROM me), fa AS (SELECT *, greatest(max(s) OVER (PARTITION BY symbol, fold, entry, leave, test ORDER BY day), 0) - s AS fall FROM sm),
 st AS (SELECT symbol, fold, entry, leave, coalesce(CASE WHEN stddev_pop(pnl) FILTER (NOT test) > 1e-12 THEN avg(pnl) FILTER (NOT test) / stddev_pop(pnl) FILTER (NOT test) * sqrt(365) END, 0) AS train_sharpe, sum(pnl) FILTER (NOT test) AS train_pnl,
  coalesce(CASE WHEN stddev_pop(pnl) FILTER (test) > 1e-12 THEN avg(pnl) FILTER (test) / stddev_pop(pnl) FILTER (test) * sqrt(365) END, 0) AS test_sharpe, sum(pnl) FILTER (test) AS test_pnl, coalesce(sum(trades) FILTER (test), 0) AS test_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) FILTER (test) AS test_win_rate, max(fall) FILTER (test) AS test_mdd FROM fa GROUP BY 1, 2, 3, 4),
 wf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY round(train_sharpe, 9) DESC, entry, leave) AS n FROM st WHERE train_pnl IS NOT NULL AND test_pnl IS NOT NULL) WHERE n = 1)"""
_FOLD = ("train_sharpe", "train_pnl", "test_sharpe", "test_pnl", "test_win_rate", "test_mdd")
add_bars(
    "wf_folds",
    f"{_WALKED} SELECT symbol, CAST(fold AS INTEGER) AS fold, entry, leave, {', '.join(r(c, c) for c in _FOLD)}, CAST(test_trades AS BIGINT) AS test_trades, {r('CASE WHEN test_trades < 3 THEN -100.0 ELSE 100 * test_pnl + 10 * test_sharpe - 50 * test_mdd + 20 * greatest(0, test_win_rate - 0.5) END', 'score')} FROM wf",
    lambda b: shown(walked(b).withColumn("score", X.run_score(F.col("test_pnl"), F.col("test_sharpe"), F.col("test_mdd"), F.col("test_win_rate"), F.col("test_trades"))), "symbol", "fold", "entry", "leave", *_FOLD, "test_trades", "score"),
)
add_bars(
    "agg_mode_stability",
    f"{_WALKED}, c AS (SELECT symbol, entry AS value, count(*) AS n, min(fold) AS f FROM wf GROUP BY 1, 2) SELECT symbol, value, n, {r('share', 'share')} FROM (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY symbol) AS share, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, f) AS k FROM c) WHERE k = 1",
    lambda b: shown(X.stability(walked(b), "entry"), "symbol", "value", "n", "share"),
)
_VERDICT = ("avg_train_sharpe", "avg_test_sharpe", "std_test_sharpe", "cumulative_pnl", "avg_test_pnl", "avg_mdd", "consistency", "param_stability")
_GRADES = ("overfit_grade", "stability_grade", "consistency_grade", "overall_grade")
add_bars(
    "agg_robustness",
    f"""{_WALKED}, a AS (SELECT symbol, count(*) AS folds, avg(train_sharpe) AS avg_train_sharpe, avg(test_sharpe) AS avg_test_sharpe, stddev_pop(test_sharpe) AS std_test_sharpe, exp(sum(ln(greatest(1 + test_pnl, 1e-12)))) - 1 AS cumulative_pnl, avg(test_pnl) AS avg_test_pnl, sum(test_trades) AS total_trades, avg(test_mdd) AS avg_mdd, avg(CASE WHEN test_sharpe > 0 THEN 1.0 ELSE 0.0 END) AS consistency FROM wf GROUP BY 1),
 ce AS (SELECT symbol, max(n) * 1.0 / sum(n) AS s FROM (SELECT symbol, entry, count(*) AS n FROM wf GROUP BY 1, 2) GROUP BY 1), cx AS (SELECT symbol, max(n) * 1.0 / sum(n) AS s FROM (SELECT symbol, leave, count(*) AS n FROM wf GROUP BY 1, 2) GROUP BY 1),
 v AS (SELECT a.*, (ce.s + cx.s) / 2 AS param_stability, CASE WHEN avg_test_sharpe > 0 THEN avg_train_sharpe / avg_test_sharpe ELSE CAST('inf' AS DOUBLE) END AS ofr FROM a JOIN ce ON ce.symbol = a.symbol JOIN cx ON cx.symbol = a.symbol),
 g AS (SELECT *, CASE WHEN ofr < 1.3 THEN 3 WHEN ofr < 1.7 THEN 2 ELSE 1 END AS g1, CASE WHEN param_stability > 0.6 THEN 3 WHEN param_stability > 0.4 THEN 2 ELSE 1 END AS g2, CASE WHEN consistency > 0.7 THEN 3 WHEN consistency > 0.5 THEN 2 ELSE 1 END AS g3 FROM v)
 SELECT symbol, folds, CAST(total_trades AS BIGINT) AS total_trades, {", ".join(r(c, c) for c in _VERDICT)}, ['HIGH', 'MODERATE', 'LOW'][g1] AS overfit_grade, ['UNSTABLE', 'MODERATE', 'STABLE'][g2] AS stability_grade, ['INCONSISTENT', 'MODERATE', 'CONSISTENT'][g3] AS consistency_grade, CASE WHEN g1 + g2 + g3 >= 7.5 THEN 'ROBUST' WHEN g1 + g2 + g3 >= 6 THEN 'ACCEPTABLE' ELSE 'WEAK' END AS overall_grade FROM g""",
    lambda b: shown(X.fold_verdict(walked(b), ["entry", "leave"]), "symbol", "folds", "total_trades", *_VERDICT, *_GRADES),
)
_INOUT = ("is_return_mean", "is_return_std", "is_sharpe_mean", "is_win_rate", "oos_return_mean", "oos_return_std", "oos_sharpe_mean", "oos_win_rate", "oos_cumulative", "return_degradation", "sharpe_degradation")
add_bars(
    "agg_is_oos",
    f"""{_WALKED}, a AS (SELECT symbol, count(*) AS folds, avg(train_pnl) AS is_return_mean, stddev_pop(train_pnl) AS is_return_std, avg(train_sharpe) AS is_sharpe_mean, 100 * avg(CASE WHEN train_pnl > 0 THEN 1.0 ELSE 0.0 END) AS is_win_rate, avg(test_pnl) AS oos_return_mean, stddev_pop(test_pnl) AS oos_return_std, avg(test_sharpe) AS oos_sharpe_mean, 100 * avg(CASE WHEN test_pnl > 0 THEN 1.0 ELSE 0.0 END) AS oos_win_rate, sum(test_pnl) AS oos_cumulative,
  avg(train_pnl) - avg(test_pnl) AS return_degradation, avg(train_sharpe) - avg(test_sharpe) AS sharpe_degradation, coalesce(corr(train_pnl, test_pnl), 0) AS cor FROM wf GROUP BY 1) SELECT symbol, folds, {", ".join(r(c, c) for c in _INOUT)}, {r('cor', 'is_oos_correlation')} FROM a""",
    lambda b: shown(X.in_and_out(walked(b)), "symbol", "folds", *_INOUT, "is_oos_correlation"),
)
add_bars(
    "agg_composite",
    f"""{_WALKED}, n AS (SELECT symbol, fold, entry, leave, test_trades >= 1 AS ok, train_sharpe, test_sharpe, -test_mdd AS calm FROM wf),
 k AS (SELECT *, {", ".join(f"min({c}) FILTER (ok) OVER (PARTITION BY symbol) AS lo_{c}, max({c}) FILTER (ok) OVER (PARTITION BY symbol) AS hi_{c}" for c in ("train_sharpe", "test_sharpe", "calm"))} FROM n)
 SELECT symbol, CAST(fold AS INTEGER) AS fold, {r("CASE WHEN ok THEN " + " + ".join(f"{w} * CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) ELSE 0 END" for c, w in (("train_sharpe", 0.2), ("test_sharpe", 0.4), ("calm", 0.4))) + " ELSE 0 END", "score")} FROM k""",
    lambda b: shown(X.composite(walked(b).withColumn("calm", -F.col("test_mdd")), {"train_sharpe": 0.2, "test_sharpe": 0.4, "calm": 0.4}, F.col("test_trades") >= 1, ["symbol"]), "symbol", "fold", "score"),
)

# ---- equity, reports, regimes of drawdown -----------------------------------------------------

for _how, _name in ((False, "eq_marked"), (True, "eq_compounded")):
    _real = "100000.0 * exp(sum(ln(greatest(1 + coalesce(x.pnl, 0), 1e-300))) OVER w)" if _how else "100000.0 + 100000.0 * sum(coalesce(x.pnl, 0)) OVER w"
    _base = "re" if _how else "100000.0"
    register(
        _name,
        f"""{C._CHAIN}, j AS (SELECT bars.symbol, bars.seq, bars.close, x.pnl AS done, {_real} AS re, max(e.entry_seq) OVER w AS since FROM bars LEFT JOIN ch x ON x.symbol = bars.symbol AND x.exit_seq = bars.seq LEFT JOIN ch e ON e.symbol = bars.symbol AND e.entry_seq = bars.seq WINDOW w AS (PARTITION BY bars.symbol ORDER BY bars.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 k AS (SELECT j.*, CASE WHEN done IS NULL AND j.seq < o.exit_seq THEN re + {_base} * o.direction * (close - o.entry_price) / o.entry_price ELSE re END AS eq FROM j LEFT JOIN ch o ON o.symbol = j.symbol AND o.entry_seq = j.since),
 l AS (SELECT *, max(CASE WHEN least(eq, re) <= 0 THEN 1 ELSE 0 END) {over()} AS gone FROM k) SELECT symbol, seq, {r('CASE WHEN gone = 1 THEN 0.0 ELSE re END', 'realised')}, {r('CASE WHEN gone = 1 THEN 0.0 ELSE eq END', 'equity')} FROM l""",
    )(bars(lambda b, how=_how: shown(T.marked_equity(b, L.chain(C.barrier_ledger(b)), compounding=how), "symbol", "seq", "realised", "equity")))
_REPORT = ("win_rate", "avg_pnl", "avg_hold", "gross_profit", "gross_loss", "profit_factor")
add_bars(
    "agg_report",
    f"""{C._CHAIN}, a AS (SELECT symbol, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(pnl) AS avg_pnl, avg(exit_seq - entry_seq) AS avg_hold, sum(greatest(pnl, 0)) AS gross_profit, -sum(least(pnl, 0)) AS gross_loss, count(*) FILTER (reason = 'TP') AS n_tp, count(*) FILTER (reason = 'SL') AS n_sl, count(*) FILTER (reason = 'TIMEOUT') AS n_timeout FROM ch GROUP BY 1),
 o AS (SELECT *, CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss WHEN gross_profit > 0 THEN CAST('inf' AS DOUBLE) ELSE 0.0 END AS profit_factor FROM a) SELECT symbol, n, n_tp, n_sl, n_timeout, {", ".join(r(c, c) for c in _REPORT)} FROM o""",
    lambda b: shown(T.ledger_report(L.chain(C.barrier_ledger(b))), "symbol", "n", "n_tp", "n_sl", "n_timeout", *_REPORT),
)
add_bars(
    "crisis_state",
    f"""{RETS}, s AS (SELECT symbol, seq, (close - max(close) {over()}) / max(close) {over()} AS drawdown, CASE WHEN count(*) {over(20)} >= 20 THEN stddev_samp(ret) {over(20)} END AS volatility FROM b), q AS (SELECT symbol, quantile_cont(volatility, 0.8) AS hi FROM s GROUP BY 1),
 e AS (SELECT s.*, hi, CASE WHEN drawdown < -0.15 THEN 1 WHEN drawdown >= -0.05 THEN 0 END AS e FROM s JOIN q ON q.symbol = s.symbol), i AS (SELECT *, coalesce(last_value(e IGNORE NULLS) {over()}, 0) AS inside FROM e)
 SELECT symbol, seq, {r('drawdown', 'drawdown')}, {r('volatility', 'volatility')}, CASE WHEN drawdown < -0.15 THEN 'crisis' WHEN inside = 1 THEN 'recovery' WHEN coalesce(volatility, 0) >= hi THEN 'normal_high_vol' ELSE 'normal_low_vol' END AS label FROM i""",
    lambda b: shown(G.drawdown_regime(b), "symbol", "seq", "drawdown", "volatility", "label"),
)
add_bars(
    "rule_zscore",
    f"""{recursive(WITH)}, z AS (SELECT symbol, seq, CASE WHEN count(*) {over(42)} >= 42 THEN (close - avg(close) {over(42)}) / (stddev_samp(close) {over(42)} + 1e-10) END AS z FROM bars),
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 0 AS position FROM z WHERE seq = 1 UNION ALL SELECT z.symbol, z.seq, CASE WHEN w.position = 1 THEN CASE WHEN z < 0 THEN 0 ELSE 1 END WHEN w.position = -1 THEN CASE WHEN z > 0 THEN 0 ELSE -1 END WHEN z > 2 THEN 1 WHEN z < -2 THEN -1 ELSE 0 END FROM walk w JOIN z ON z.symbol = w.symbol AND z.seq = w.seq + 1)
 SELECT symbol, seq, CAST(position AS INTEGER) AS position FROM walk WHERE seq > 0""",
    lambda b: R.latch(ruled(b), *U.rule_zscore().values()).select("symbol", "seq", "position"),
)
add_bars(
    "zigzag",
    f"""{recursive(WITH)}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) {BY}), abs(low - lag(close) {BY})) AS tr FROM bars), a AS (SELECT *, CASE WHEN count(tr) {over(14)} >= 14 THEN avg(tr) {over(14)} END AS atr FROM t),
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 1 AS side, CAST(high AS DOUBLE) AS best, seq AS pos, CAST(-4 AS BIGINT) AS lp, false AS out, CAST(0 AS BIGINT) AS ps, 0 AS pv, {_ZERO} AS pp FROM a WHERE seq = 1 UNION ALL
  SELECT symbol, seq, CASE WHEN turn THEN -side ELSE side END, CASE WHEN better OR turn THEN CASE WHEN (side > 0) <> turn THEN high ELSE low END ELSE best END, CASE WHEN better OR turn THEN seq ELSE pos END, CASE WHEN turn THEN pos ELSE lp END, turn, pos, side, best
  FROM (SELECT *, coalesce(NOT better AND (CASE WHEN side > 0 THEN best - low ELSE high - best END) >= 2 * atr AND pos - lp >= 5, false) AS turn
   FROM (SELECT w.symbol, a.seq, w.side, w.best, w.pos, w.lp, a.high, a.low, a.atr, CASE WHEN w.side > 0 THEN a.high >= w.best ELSE a.low <= w.best END AS better FROM walk w JOIN a ON a.symbol = w.symbol AND a.seq = w.seq + 1)))
 SELECT symbol, ps AS seq, CAST(pv AS INTEGER) AS side, {r('pp', 'price')} FROM walk WHERE out""",
    lambda b: shown(G.zigzag(W.atr(b)).withColumnRenamed("pivot", "side"), "symbol", "seq", "side", "price"),
)
add_bars(
    "win_entropy",
    f"""{RETS}, v AS (SELECT symbol, seq, ret, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS rv FROM b), x AS (SELECT symbol, seq, CASE WHEN rv > 1e-8 THEN ret / rv ELSE ret END AS x FROM v),
 m AS (SELECT *, count(*) {over(24)} AS n, min(x) {over(24)} AS lo, max(x) {over(24)} AS hi FROM x), p AS (SELECT m.symbol, m.seq, least(CAST(floor((k.x - m.lo) / (m.hi - m.lo) * 10) AS INTEGER), 9) AS slot, count(*) AS c FROM m JOIN x k ON k.symbol = m.symbol AND k.seq > m.seq - 24 AND k.seq <= m.seq WHERE m.n >= 24 AND m.hi - m.lo >= 1e-10 GROUP BY 1, 2, 3),
 e AS (SELECT symbol, seq, -sum(c / 24.0 * ln(c / 24.0)) / ln(10) AS entropy FROM p GROUP BY 1, 2) SELECT x.symbol, x.seq, {r('coalesce(entropy, 0.0)', 'entropy')} FROM x LEFT JOIN e ON e.symbol = x.symbol AND e.seq = x.seq""",
    lambda b: shown(W.histogram_entropy(b), "symbol", "seq", "entropy"),
)
add_bars(
    "win_hurst_rs",
    f"""{RETS}, n AS (SELECT symbol, seq, count(ret) {over(100)} AS n, avg(ret) {over(100)} AS m, stddev_pop(ret) {over(100)} AS s FROM b),
 c AS (SELECT n.symbol, n.seq, n.n, n.s, sum(k.ret - n.m) OVER (PARTITION BY n.symbol, n.seq ORDER BY k.seq) AS c FROM n JOIN b k ON k.symbol = n.symbol AND k.seq > n.seq - 100 AND k.seq <= n.seq WHERE n.n >= 20),
 h AS (SELECT symbol, seq, any_value(n) AS n, any_value(s) AS s, greatest(max(c), 0) - least(min(c), 0) AS rg FROM c GROUP BY 1, 2)
 SELECT n.symbol, n.seq, {r('CASE WHEN n.n >= 20 THEN least(greatest(CASE WHEN h.s > 1e-12 AND rg > 0 THEN ln(rg / h.s) / ln(h.n) ELSE 0.5 END, 0.0), 1.0) END', 'hurst')} FROM n LEFT JOIN h ON h.symbol = n.symbol AND h.seq = n.seq""",
    lambda b: shown(G.hurst_rs(W.returns(b), "ret"), "symbol", "seq", "hurst"),
)


def plateau(b: DataFrame) -> DataFrame:
    """The broadest good region of entry and exit levels, by what all symbols made."""
    b = W.zscore(b, "close", 20)
    steps = [{"entry": 0.5 + 0.25 * i, "leave": 0.25 * j} for i in range(8) for j in range(4)]
    sums = X.band_results(X.gridded(b, steps), "z").groupBy("entry", "leave").agg(F.sum("pnl").alias("score"))
    return G.plateau_center(sums.select(F.round((F.col("entry") - 0.5) / 0.25).alias("entry"), F.round(F.col("leave") / 0.25).alias("leave"), "score"), ["entry", "leave"], q=0.7)


add_bars("plateau_center", None, lambda b: shown(plateau(b), "entry", "leave", "cells", "best"))
add_bars(
    "lab_tbm_kept",
    f"""{C._TBM}, c AS (SELECT l.symbol, l.seq, s.sigma, 2 * (0.0004 + least(0.005, 0.0001 + 0.1 * s.sigma * sqrt(0.01))) AS cost FROM l JOIN s ON s.symbol = l.symbol AND s.seq = l.seq) SELECT symbol, count(*) FILTER (2.0 * sigma > 1.5 * cost) AS kept, count(*) FILTER (NOT 2.0 * sigma > 1.5 * cost) AS dropped FROM c GROUP BY 1""",
    lambda b: L.fee_trapped(C.tbm(b).join(W.volatility(b).select("symbol", "seq", F.col("realized_vol").alias("sigma")), ["symbol", "seq"]), F.col("sigma"), 2.0),
)

# ---- pyramids, ablation, further labels, modes ------------------------------------------------

_PYRAMID = ("total_size", "stop", "average_entry")
add_bars(
    "led_pyramid",
    f"""{recursive(_BAND)}, i AS (SELECT symbol, seq, close, sig, sqrt(coalesce(var_samp(ln(close)) {over(20)}, 0.0)) AS sd FROM g),
 walk AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 0 AS side, 0 AS n, {_ZERO} AS lastp, {_ZERO} AS avgp, {_ZERO} AS tot, {_ZERO} AS sl FROM i WHERE seq = 1 UNION ALL
  SELECT symbol, seq, CASE act WHEN 'in' THEN sig WHEN 'out' THEN 0 WHEN 'flat' THEN 0 ELSE side END, CASE act WHEN 'in' THEN 1 WHEN 'add' THEN n + 1 WHEN 'hold' THEN n ELSE 0 END, CASE WHEN act IN ('in', 'add') THEN close ELSE lastp END, na, nt, CASE WHEN act IN ('in', 'add') THEN na * exp(-(CASE act WHEN 'in' THEN sig ELSE side END) * 1.5 * sd) ELSE sl END
  FROM (SELECT *, CASE act WHEN 'in' THEN close WHEN 'add' THEN (tot * avgp + least(1.0, 3.0 - tot) * close) / (tot + least(1.0, 3.0 - tot)) ELSE avgp END AS na, CASE act WHEN 'in' THEN {_ONE} WHEN 'add' THEN tot + least(1.0, 3.0 - tot) WHEN 'hold' THEN tot ELSE {_ZERO} END AS nt
   FROM (SELECT w.*, CASE WHEN w.side = 0 AND sig <> 0 THEN 'in' WHEN w.side = 0 THEN 'flat' WHEN sig <> w.side OR w.side * (close - w.sl) <= 0 THEN 'out' WHEN w.n < 3 AND w.tot < 3 AND w.side * (close - w.lastp * exp(w.side * 1.5 * sd)) >= 0 THEN 'add' ELSE 'hold' END AS act
    FROM (SELECT walk.symbol, i.seq, side, n, lastp, avgp, tot, sl, close, sig, sd FROM walk JOIN i ON i.symbol = walk.symbol AND i.seq = walk.seq + 1) w)))
 SELECT symbol, seq, CAST(side AS INTEGER) AS position, CAST(n AS INTEGER) AS entries, {r('tot', 'total_size')}, {r('CASE WHEN side <> 0 THEN sl END', 'stop')}, {r('CASE WHEN side <> 0 THEN avgp END', 'average_entry')} FROM walk WHERE seq > 0""",
    lambda b: shown(A.pyramid(banded(b), F.col("sig"), F.coalesce(F.var_samp(F.log("close")).over(W.last_rows(20)), F.lit(0.0))), "symbol", "seq", "position", "entries", *_PYRAMID),
)
REASONS = ("hard", "trail", "break", "signal")
#: All exits, and all but each.
ABLATIONS = [{f"use_{x}": float(x != out) for x in REASONS} for out in (None, *REASONS)]


def ablated(b: DataFrame) -> DataFrame:
    """Exits by reason and what trades made, with each exit of `stopped` left out in turn. A stop that is left out lies where no price is."""
    b = W.returns(b)
    b = b.withColumns({"rv": F.stddev_samp("log_ret").over(W.last_rows(24)), "sma": F.avg("close").over(W.last_rows(20)), "v": F.log(F.col("close") / F.lag("close", 5).over(W.by_seq()))})
    g = X.gridded(b, ABLATIONS)
    rv, v, ret = F.col("rv"), F.col("v"), F.col("log_ret")
    on = {x: F.col(f"use_{x}") == 1 for x in REASONS}
    far = F.lit(1e9)
    k, mae = F.when(on["trail"], 2.0).otherwise(far), F.when(on["hard"], 3 * rv).when(rv.isNotNull(), far)
    enter = F.when(v > 0, 1).when(v < 0, -1)
    below, above = F.col("close") < F.col("sma"), F.col("close") > F.col("sma")
    stops = A.trailing_stop(g, enter, F.when(rv > 0, rv), k, k, mae, mae, on["break"] & (ret < -2 * rv), on["break"] & (ret > 2 * rv), on["signal"] & below & (v < 0), on["signal"] & above & (v > 0))
    trades = A.stop_trades(stops).withColumns({"variant": F.element_at(F.array(*[F.lit(x) for x in ("all", *[f"no_{x}" for x in REASONS])]), F.regexp_extract("symbol", r"#(\d+)$", 1).cast("int") + 1)})
    return X.ungridded(trades).groupBy("symbol", "variant").agg(F.count("*").alias("trades"), *[F.count_if(F.col("reason") == x).alias(f"n_{x}") for x in REASONS], F.sum("log_return").alias("log_return"), F.avg((F.col("log_return") > 0).cast("double")).alias("win_rate"))


_ABLATED = stop_sql(
    f"""{recursive(RETS)}, s AS (SELECT *, stddev_samp(log_ret) {over(24)} AS rv, avg(close) {over(20)} AS sma, ln(close / lag(close, 5) {BY}) AS v FROM b), va AS (SELECT unnest(['all', 'no_hard', 'no_trail', 'no_break', 'no_signal']) AS va),
 i AS (SELECT symbol || '#' || va AS symbol, seq, high, low, close, CASE WHEN rv IS NULL THEN 0 WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END AS enter, nullif(rv, 0) AS width, CASE WHEN va = 'no_trail' THEN 1e9 ELSE 2.0 END AS kl, CASE WHEN va = 'no_trail' THEN 1e9 ELSE 2.0 END AS ks, CASE WHEN va = 'no_hard' THEN 1e9 ELSE 3 * rv END AS ml, CASE WHEN va = 'no_hard' THEN 1e9 ELSE 3 * rv END AS ms,
  coalesce(log_ret < -2 * rv, false) AND va <> 'no_break' AS bl, coalesce(log_ret > 2 * rv, false) AND va <> 'no_break' AS bs, coalesce(close < sma AND v < 0, false) AND va <> 'no_signal' AS ll, coalesce(close > sma AND v > 0, false) AND va <> 'no_signal' AS ls FROM s, va)"""
).replace("exp(-k * width)", "exp(greatest(-k * width, -700))").replace("exp(k * width)", "exp(least(k * width, 700))").replace("exp(-i.ml)", "exp(greatest(-i.ml, -700))").replace("exp(i.ms)", "exp(least(i.ms, 700))")
add_bars(
    "agg_ablation",
    f"""{_ABLATED}, tr AS (SELECT split_part(x.symbol, '#', 1) AS symbol, split_part(x.symbol, '#', 2) AS variant, x.reason, e.side * ln(coalesce(x.exit_price, xb.close) / eb.close) AS lr FROM walk x JOIN walk e ON e.symbol = x.symbol AND e.seq = x.since JOIN i eb ON eb.symbol = e.symbol AND eb.seq = e.seq JOIN i xb ON xb.symbol = x.symbol AND xb.seq = x.seq WHERE x.reason IS NOT NULL)
 SELECT symbol, variant, count(*) AS trades, {", ".join(f"count(*) FILTER (reason = '{x}') AS n_{x}" for x in REASONS)}, {r('sum(lr)', 'log_return')}, {r('avg(CASE WHEN lr > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')} FROM tr GROUP BY 1, 2""",
    lambda b: shown(ablated(b), "symbol", "variant", "trades", *[f"n_{x}" for x in REASONS], "log_return", "win_rate"),
)
add_bars(
    "lab_hybrid",
    f"""{RETS}, s AS (SELECT symbol, seq, bar_ts, close, stddev_samp(log_ret) {over(24)} AS sg, lag(bar_ts) {BY} AS pv FROM b),
 p AS (SELECT a.symbol, a.seq, a.close AS entry, k.seq AS ks, k.close AS kc, CASE WHEN k.close >= a.close * (1 + a.sg) THEN 1 WHEN k.close <= a.close * (1 - a.sg) THEN -1 END AS side FROM s a JOIN s k ON k.symbol = a.symbol AND k.seq > a.seq AND k.seq <= a.seq + 20 AND k.pv < a.bar_ts + INTERVAL 48 HOUR WHERE a.sg > 0),
 h AS (SELECT symbol, seq, entry, min(ks) FILTER (side IS NOT NULL) AS hs, arg_min(side, ks) FILTER (side IS NOT NULL) AS side, arg_min(kc, ks) FILTER (side IS NOT NULL) AS hc, max(ks) AS es, arg_max(kc, ks) AS ec FROM p GROUP BY 1, 2, 3)
 SELECT symbol, seq, CAST(coalesce(side, 0) AS INTEGER) AS label, {r('coalesce(hc, ec) / entry - 1', 'ret')}, coalesce(hs, es) AS exit_seq FROM h""",
    lambda b: shown(L.hybrid_labels(W.returns(b).withColumn("sg", F.stddev_samp("log_ret").over(W.last_rows(24))), "sg"), "symbol", "seq", "label", "ret", F.col("exit_seq").cast("long").alias("exit_seq")),
)
add_bars(
    "patch_mask",
    f"""{WITH}, s AS (SELECT symbol, seq, list(close) {over(start="48 PRECEDING", end="1 PRECEDING")} AS v FROM bars), w AS (SELECT * FROM s WHERE len(v) = 48), o AS (SELECT symbol, seq, v, p, row_number() OVER (PARTITION BY symbol, seq ORDER BY md5('42:' || symbol || ':' || seq || ':' || p)) AS k FROM (SELECT symbol, seq, v, unnest(range(6)) AS p FROM w)),
 h AS (SELECT symbol, seq, any_value(v) AS v, list(p ORDER BY p) FILTER (k <= 2) AS m FROM o GROUP BY 1, 2)
 SELECT symbol, seq, array_to_string(m, ',') AS masked, {r('list_sum(v) - list_sum(v[m[1] * 8 + 1 : m[1] * 8 + 8]) - list_sum(v[m[2] * 8 + 1 : m[2] * 8 + 8])', 'total')} FROM h""",
    lambda b: shown(
        L.patch_masks(L.context_windows(b, ["close"], 48).withColumn("x", F.transform("context", lambda x: x["close"])), "x", patch=8).select("symbol", "seq", F.array_join("masked", ",").alias("masked"), F.aggregate("x", F.lit(0.0), lambda a, x: a + x).alias("total")),
        "symbol", "seq", "masked", "total",
    ),
)


def moded(b: DataFrame) -> DataFrame:
    b = G.hurst_rs(W.returns(b).withColumns({"sma": F.avg("close").over(W.last_rows(20)), "vol": F.stddev_samp("log_ret").over(W.last_rows(20))}), "ret")
    regime = F.when(F.expr(_MODE[0]), "bull").when(F.expr(_MODE[1]), "bear").otherwise("sideways")
    return G.hybrid_mode(b, regime, 0.5 + 0.5 * F.abs(F.col("close") - F.col("open")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.col("hurst"), F.col("vol"))


_SCALE = " ".join(f"WHEN '{m}' THEN {v}" for m, v in G.MODE_SCALES.items())
add_bars(
    "hybrid_mode",
    f"""{C.ORACLE_SQL["win_hurst_rs"].rpartition(" SELECT n.symbol, n.seq, ")[0]}, hu AS (SELECT n.symbol, n.seq, CASE WHEN n.n >= 20 THEN least(greatest(CASE WHEN h.s > 1e-12 AND rg > 0 THEN ln(rg / h.s) / ln(h.n) ELSE 0.5 END, 0.0), 1.0) END AS hurst FROM n LEFT JOIN h ON h.symbol = n.symbol AND h.seq = n.seq),
 f0 AS (SELECT b.*, avg(close) {over(20)} AS sma, stddev_samp(log_ret) {over(20)} AS vol, 0.5 + 0.5 * abs(close - open) / nullif(high - low, 0) AS p FROM b),
 f AS (SELECT f0.*, hurst, CASE WHEN {_MODE[0]} THEN 'bull' WHEN {_MODE[1]} THEN 'bear' ELSE 'sideways' END AS rg FROM f0 JOIN hu ON hu.symbol = f0.symbol AND hu.seq = f0.seq),
 mo AS (SELECT *, avg(vol) OVER (PARTITION BY symbol) AS vm, stddev_samp(vol) OVER (PARTITION BY symbol) AS vs, CASE WHEN hurst IS NULL THEN 'neutral' WHEN coalesce(p, 0) < 0.6 THEN 'cautious' WHEN hurst < 0.45 THEN 'mean_reversion' WHEN rg = 'bull' AND hurst > 0.55 THEN 'momentum_long' WHEN rg = 'bear' AND hurst > 0.55 THEN 'momentum_short' WHEN rg = 'bull' THEN 'cautious' WHEN rg = 'bear' THEN 'defensive' ELSE 'neutral' END AS mode FROM f)
 SELECT symbol, seq, mode, {r(f"CASE WHEN hurst IS NULL THEN 0.2 WHEN coalesce(p, 0) < 0.6 THEN 0.5 ELSE least(1.0, greatest(0.2, CASE mode {_SCALE} END * least(p / 0.6, 1.0) * (0.7 + 0.3 * abs(hurst - 0.5) * 2) * exp(-0.3 * greatest(0, coalesce((vol - vm) / (vs + 1e-10), 0))))) END", 'scale')} FROM mo""",
    lambda b: shown(moded(b), "symbol", "seq", "mode", "scale"),
)

# ---- rules on the filter's columns ------------------------------------------------------------


def ranked_sql(table: str, column: str, n: int, least: int, name: str, extra: str = "") -> str:
    """A table `name`_r of symbol, seq and `name`: the rank of the last value among n, ties sharing theirs; 0.5 with fewer than `least`."""
    return f"""{name}_r AS (SELECT a.symbol, a.seq, CASE WHEN count(*) >= {least} THEN (count(*) FILTER (k.{column} < a.{column}) + (count(*) FILTER (k.{column} = a.{column}) + 1) / 2.0) / count(*) ELSE 0.5 END AS {name} FROM {table} a JOIN {table} k ON k.symbol = a.symbol AND k.seq > a.seq - {n} AND k.seq <= a.seq GROUP BY a.symbol, a.seq)"""


def walk_sql(inputs: str, policy: str) -> str:
    """The positions of a latch over a table f of symbol, seq, el, es, xl and xs."""
    return f"""{inputs}, held AS (SELECT symbol, CAST(0 AS BIGINT) AS seq, 0 AS position FROM f WHERE seq = 1 UNION ALL
  SELECT f.symbol, f.seq, CASE WHEN w.position = 1 THEN {C._held(1, policy)} WHEN w.position = -1 THEN {C._held(-1, policy)} ELSE {C._FRESH} END FROM held w JOIN f ON f.symbol = w.symbol AND f.seq = w.seq + 1)
 SELECT symbol, seq, CAST(position AS INTEGER) AS position FROM held WHERE seq > 0"""


_GAIN = 1 - 2 / 15
_IMPULSE = f"""{FILTER2}, im0 AS (SELECT *, coalesce(kf_trend - lag(kf_trend) {BY}, 0.0) AS st, close - kf_trend_pred AS dv, abs(kf_velocity) / (kf_uncertainty + 1e-10) AS ef FROM kf),
 im1 AS (SELECT *, pow({_GAIN!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN 0 ELSE {1 - _GAIN!r} * greatest(st, 0) END * pow({_GAIN!r}, 1 - seq)) {over()} AS up, pow({_GAIN!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN 0 ELSE {1 - _GAIN!r} * greatest(-st, 0) END * pow({_GAIN!r}, 1 - seq)) {over()} AS dn,
  coalesce(CASE WHEN count(*) {over(20)} >= 5 THEN stddev_samp(dv) {over(20)} END, stddev_samp(dv) OVER (PARTITION BY symbol)) AS sd, coalesce(CASE WHEN count(*) {over(100)} >= 20 THEN quantile_cont(kf_uncertainty, 0.95) {over(100)} END, max(kf_uncertainty) OVER (PARTITION BY symbol)) AS cap FROM im0),
 {ranked_sql("im0", "ef", 100, 20, "efficiency")},
 im AS (SELECT i.*, efficiency, 100 - 100 / (1 + up / (dn + 1e-10)) AS kf_rsi, least(5.0, greatest(-5.0, dv / CASE WHEN sd = 0 THEN 1e-10 ELSE sd END)) AS z_score, coalesce(efficiency > 0.4 AND kf_uncertainty < cap, false) AS trending FROM im1 i JOIN efficiency_r e ON e.symbol = i.symbol AND e.seq = i.seq)"""
_IM = ("kf_rsi", "z_score", "efficiency")
add_bars("win_kf_rsi_z", f"{_IMPULSE} SELECT symbol, seq, {', '.join(r(c, c) for c in _IM)}, trending FROM im", lambda b: shown(I.impulse_features(filtered(b)), "symbol", "seq", *_IM, F.coalesce("trending", F.lit(False)).alias("trending")))
add_bars(
    "rule_impulse",
    walk_sql(f"{_IMPULSE}, f AS (SELECT symbol, seq, trending AND kf_velocity > 0 AND z_score > 1 AND kf_rsi < 70 AS el, trending AND kf_velocity < 0 AND z_score < -1 AND kf_rsi > 30 AS es, NOT trending OR close < kf_trend AS xl, NOT trending OR close > kf_trend AS xs FROM im)", "d"),
    lambda b: R.latch(I.impulse_features(filtered(b)), *U.rule_impulse().values(), policy="d").select("symbol", "seq", "position"),
)
add_bars(
    "rule_dual_track",
    walk_sql(
        f"""{_IMPULSE}, f AS (SELECT symbol, seq, trending AND kf_velocity > 0 AND (z_score > 1.75 AND kf_rsi < 75 OR z_score BETWEEN -0.5 AND 0.5 AND kf_rsi < 60) AS el, trending AND kf_velocity < 0 AND (z_score < -1.75 AND kf_rsi > 25 OR z_score BETWEEN -0.5 AND 0.5 AND kf_rsi > 40) AS es,
  NOT trending OR close < kf_trend - 1.5 * kf_uncertainty AS xl, NOT trending OR close > kf_trend + 1.5 * kf_uncertainty AS xs FROM im)""",
        "bd",
    ),
    lambda b: R.latch(I.impulse_features(filtered(b)), *U.rule_dual_track().values(), policy="bd").select("symbol", "seq", "position"),
)


def percentile_rule(b: DataFrame) -> DataFrame:
    rows, rule = U.rule_percentile(filtered(b))
    return R.latch(rows, *rule.values()).select("symbol", "seq", "position")


add_bars(
    "rule_percentile",
    walk_sql(
        f"""{FILTER2}, pc0 AS (SELECT *, CASE WHEN count(*) {over(42)} >= 5 THEN (kf_velocity - avg(kf_velocity) {over(42)}) / (stddev_samp(kf_velocity) {over(42)} + 1e-10) END AS vz, ln(close / kf_trend) AS rs FROM kf),
 pc AS (SELECT *, CASE WHEN count(vz) {over(540)} >= 100 THEN quantile_cont(vz, 0.95) {over(540)} END AS hi, CASE WHEN count(vz) {over(540)} >= 100 THEN quantile_cont(vz, 0.05) {over(540)} END AS lo, CASE WHEN count(*) {over(180)} >= 30 THEN stddev_samp(rs) {over(180)} END AS sd FROM pc0), {ranked_sql("kf", "kf_uncertainty", 210, 20, "unsure")},
 f AS (SELECT pc.symbol, pc.seq, coalesce(vz > hi AND unsure < 0.5 AND pc.seq > 540, false) AS el, coalesce(vz < lo AND unsure < 0.5 AND pc.seq > 540, false) AS es, coalesce(rs < -3 * sd, false) OR coalesce(vz < lo, false) AS xl, coalesce(rs > 3 * sd, false) OR coalesce(vz > hi, false) AS xs FROM pc JOIN unsure_r u ON u.symbol = pc.symbol AND u.seq = pc.seq)""",
        "a",
    ),
    percentile_rule,
)


def switched(b: DataFrame) -> DataFrame:
    b = R.wilder_rsi(W.zscore(W.volatility(b), "close", 20, "z20"), "close", 14)
    b = b.withColumns({"mom": F.col("close") / F.lag("close", 10).over(W.by_seq()) - 1, "sma": F.avg("close").over(W.last_rows(20))})
    return I.hurst_switch(G.hurst_rs(b, "ret"), "mom", "z20", "rsi", "hurst", "sma", "realized_vol", fade=1.0)


_HURST_SQL = C.ORACLE_SQL["win_hurst_rs"].rpartition(" SELECT n.symbol, n.seq, ")[0]
add_bars(
    "rule_hurst_switch",
    f"""{_HURST_SQL}, hu AS (SELECT n.symbol, n.seq, CASE WHEN n.n >= 20 THEN least(greatest(CASE WHEN h.s > 1e-12 AND rg > 0 THEN ln(rg / h.s) / ln(h.n) ELSE 0.5 END, 0.0), 1.0) END AS hurst FROM n LEFT JOIN h ON h.symbol = n.symbol AND h.seq = n.seq),
 q0 AS (SELECT symbol, seq, close, ret, greatest(coalesce(close - lag(close) {BY}, 0), 0) AS g, greatest(-coalesce(close - lag(close) {BY}, 0), 0) AS l, close / lag(close, 10) {BY} - 1 AS mom, avg(close) {over(20)} AS sma, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS rv, CASE WHEN count(*) {over(20)} >= 20 THEN (close - avg(close) {over(20)}) / (stddev_samp(close) {over(20)} + 1e-10) END AS z FROM b),
 q1 AS (SELECT *, pow({C._RSI!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN g ELSE g / 14 * pow({C._RSI!r}, 1 - seq) END) {over()} AS up, pow({C._RSI!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN l ELSE l / 14 * pow({C._RSI!r}, 1 - seq) END) {over()} AS dn, CASE WHEN count(mom) {over(50)} >= 50 THEN (mom - avg(mom) {over(50)}) / (stddev_samp(mom) {over(50)} + 1e-10) END AS mz, quantile_cont(rv, 0.95) OVER (PARTITION BY symbol) AS wild FROM q0),
 q AS (SELECT *, CASE WHEN up < 1e-10 AND dn < 1e-10 THEN 50.0 WHEN dn < 1e-10 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END AS rsi FROM q1),
 o AS (SELECT q.symbol, q.seq, hurst, rv, wild, CASE WHEN mz > 1 AND close > sma AND rsi < 80 THEN 1 WHEN mz < -1 AND close < sma AND rsi > 20 THEN -1 ELSE 0 END AS go, CASE WHEN z < -1 AND rsi < 35 THEN 1 WHEN z > 1 AND rsi > 65 THEN -1 ELSE 0 END AS back FROM q JOIN hu ON hu.symbol = q.symbol AND hu.seq = q.seq)
 SELECT symbol, seq, CAST(go AS INTEGER) AS momentum_signal, CAST(back AS INTEGER) AS revert_signal, CAST(CASE WHEN rv > wild THEN 0 WHEN hurst > 0.55 THEN go WHEN hurst < 0.45 THEN back ELSE 0 END AS INTEGER) AS signal FROM o""",
    lambda b: switched(b).select("symbol", "seq", "momentum_signal", "revert_signal", "signal"),
)
add_bars("win_hurst_rolling", None, lambda b: shown(S.hurst_rolling(W.returns(b), "log_ret"), "symbol", "seq", "hurst", "r2", "regime"))
