"""Registered queries of the market operators, each over whole tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning as N
from ..functions import sizing as Z
from ..operators import labels as L
from ..operators import recurrences as R
from ..operators import regimes as G
from ..operators import rules as U
from ..operators import signals as I
from ..operators import windows as W
from ..sources import market as M
from ..streaming import trades as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
D = 6


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def shown(df: DataFrame, *columns) -> DataFrame:
    """The columns, doubles rounded so that sums taken in another order compare equal."""
    out = df.select(*columns)
    return out.select(*[(F.round(c, D) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def r(expression: str, name: str) -> str:
    return f"round({expression}, {D}) + 0.0 AS {name}"


def over(n: int | None = None, start: str | None = None, end: str = "CURRENT ROW") -> str:
    first = start or (f"{n - 1} PRECEDING" if n else "UNBOUNDED PRECEDING")
    return f"OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {first} AND {end})"


BY = "OVER (PARTITION BY symbol ORDER BY seq)"
RET = f"coalesce(close / lag(close) {BY} - 1, 0.0)"
WITH = f"WITH {M.BARS_SQL}"
RETS = f"{WITH}, b AS (SELECT *, {RET} AS ret, ln(close / lag(close) {BY}) AS log_ret FROM bars)"


def bars(f):
    return lambda spark, d: f(M.bars(spark, d))


def add_bars(name, sql, f):
    register(name, sql)(bars(f))


# ---- sources ----------------------------------------------------------------------------------

register("src_trade_validate", f"""WITH {M.RAW_TRADES_SQL} SELECT CASE WHEN price <= 0 THEN 'price' WHEN qty < 0 THEN 'qty' WHEN quote_qty < 0 THEN 'quote_qty' WHEN ts_ms <= 0 THEN 'ts_ms' WHEN trade_id <= 0 THEN 'trade_id' ELSE 'ok' END AS reason, count(*) AS n FROM raw_trades GROUP BY 1""")(
    lambda spark, d: M.raw_trades(spark, d).groupBy(F.coalesce(M.invalid_reason(), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))
)
register("src_aggressor", f"WITH {M.TRADES_SQL} SELECT symbol, is_aggressor_buy, count(*) AS n, {r('sum(quote_qty)', 'quote_qty')} FROM trades GROUP BY 1, 2")(
    lambda spark, d: shown(M.trades(spark, d).groupBy("symbol", "is_aggressor_buy").agg(F.count("*").alias("n"), F.sum("quote_qty").alias("quote_qty")), "symbol", "is_aggressor_buy", "n", "quote_qty")
)
register("src_month_list", "SELECT strftime(m, '%Y-%m') AS ym FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate) - INTERVAL 30 DAY), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS m FROM orders)")(
    lambda spark, d: M.table(spark, d, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).select(F.explode(F.expr("sequence(trunc(date_sub(a, 30), 'MM'), trunc(b, 'MM'), interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("ym"))
)
register("agg_month_checkpoint", f"WITH {M.TRADES_SQL} SELECT symbol, strftime(ts, '%Y-%m') AS ym, count(*) AS n, min(trade_id) AS first_id, max(trade_id) AS last_id FROM trades GROUP BY 1, 2")(
    lambda spark, d: M.trades(spark, d).groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("ym")).agg(F.count("*").alias("n"), F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id"))
)

# ---- per-row formulas -------------------------------------------------------------------------

FEATURES = "log_volume log_tick_count log_duration log_trade_intensity vwap_dev imbalance range_pct body_pct vwap buy_ratio avg_trade_size hour_sin hour_cos day_sin day_cos typ_price".split()
_F = ["ln(1 + volume)", "ln(1 + ticks)", "ln(1 + duration)", "ln(1 + dollar / greatest(duration, 1e-10))", "(close - dollar / greatest(volume, 1e-10)) / (close + 1e-10)", "(2 * buy - dollar) / greatest(dollar, 1e-10)", "(high - low) / close", "(close - open) / close", "dollar / (volume + 1e-10)", "buy / (dollar + 1e-10)", "dollar / (ticks + 1e-10)", "sin(2 * pi() * hour(bar_ts) / 24)", "cos(2 * pi() * hour(bar_ts) / 24)", "sin(2 * pi() * dayofweek(bar_ts) / 7)", "cos(2 * pi() * dayofweek(bar_ts) / 7)", "(high + low + close) / 3"]
add_bars("l1_features", f"{WITH} SELECT symbol, seq, {', '.join(r(e, n) for e, n in zip(_F, FEATURES))} FROM bars", lambda b: shown(U.bar_features(b), "symbol", "seq", *FEATURES))


@register(
    "cost_model",
    f"""{RETS}, s AS (SELECT *, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS sigma, avg(volume) {over(100)} AS av FROM b),
 t AS (SELECT *, CASE WHEN av <= 0 THEN 0.005 ELSE least(0.005, 0.0001 + 0.1 * sigma * sqrt(greatest(1.0 / av, 0.0))) END AS slip FROM s)
 SELECT symbol, seq, {r('slip', 'slip')}, {r('2 * (0.0004 + slip)', 'cost')}, {r('close * (1 + slip)', 'long_fill')}, {r('close * (1 - slip)', 'short_fill')}, {r('(close - open) / open - 0.0008', 'pnl')},
 2.0 * sigma > 1.5 * 2 * (0.0004 + slip) AS keep FROM t""",
)
def cost_model(spark: SparkSession, d: str) -> DataFrame:
    b = W.averages(W.volatility(M.bars(spark, d)))
    b = b.withColumn("slip", U.slippage(F.col("realized_vol"), F.lit(1.0), F.col("avg_volume")))
    cost = U.round_trip_cost(F.col("slip"))
    b = b.withColumns({"cost": cost, "long_fill": U.fill_price(F.col("close"), F.lit(1), F.col("slip")), "short_fill": U.fill_price(F.col("close"), F.lit(-1), F.col("slip")), "pnl": U.net_pnl(F.col("open"), F.col("close"), F.lit(1)), "keep": U.fee_trap(F.col("realized_vol"), cost, 2.0)})
    return shown(b, "symbol", "seq", "slip", "cost", "long_fill", "short_fill", "pnl", "keep")


add_bars(
    "size_models",
    f"""{WITH}, u AS (SELECT *, percent_rank() OVER (PARTITION BY symbol ORDER BY volume, seq) AS u FROM bars)
 SELECT symbol, seq, {r('2 * exp(-u * u / 0.5)', 'gaussian')}, {r('1 + cos(pi() * u)', 'cosine')}, {r('2 * (1 - u) * (1 - u)', 'poly')}, {r('1 + 0.5 * (exp(8 * (0.5 - u)) - 1) / (exp(8 * (0.5 - u)) + 1)', 'tanh')} FROM u""",
    lambda b: shown(b.withColumn("u", F.percent_rank().over(Window.partitionBy("symbol").orderBy("volume", "seq"))).withColumns({"gaussian": U.size_gaussian(F.col("u")), "cosine": U.size_cosine(F.col("u")), "poly": U.size_poly(F.col("u")), "tanh": U.size_tanh(F.col("u"))}), "symbol", "seq", "gaussian", "cosine", "poly", "tanh"),
)

# ---- windows ----------------------------------------------------------------------------------

_GK = "0.5 * ln(high / greatest(low, 1e-10)) * ln(high / greatest(low, 1e-10)) - (2 * ln(2) - 1) * ln(close / greatest(open, 1e-10)) * ln(close / greatest(open, 1e-10))"
_PK = "ln(high / low) * ln(high / low) / (4 * ln(2))"
add_bars("win_return", f"{RETS} SELECT symbol, seq, {r('ret', 'ret')}, {r('log_ret', 'log_ret')} FROM b", lambda b: shown(W.returns(b), "symbol", "seq", "ret", "log_ret"))
add_bars(
    "win_volatility",
    f"""{RETS}, v AS (SELECT symbol, seq, sqrt(greatest(0.0, avg({_GK}) {over(24)})) AS gk_vol, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS realized_vol, CASE WHEN count(*) {over(24)} >= 24 THEN sqrt(avg({_PK}) {over(24)}) END AS pk_vol FROM b),
 x AS (SELECT *, CASE WHEN realized_vol > 1e-10 THEN gk_vol / realized_vol END AS q FROM v)
 SELECT symbol, seq, {r('gk_vol', 'gk_vol')}, {r('realized_vol', 'realized_vol')}, {r('pk_vol', 'pk_vol')}, {r(f"coalesce(last_value(q IGNORE NULLS) {over()}, 0.0)", 'vol_ratio')} FROM x""",
    lambda b: shown(W.volatility(b), "symbol", "seq", "gk_vol", "realized_vol", "pk_vol", "vol_ratio"),
)
add_bars("win_zscore_roll", f"{WITH} SELECT symbol, seq, {r(f'CASE WHEN count(close) {over(42)} >= 42 THEN (close - avg(close) {over(42)}) / (stddev_samp(close) {over(42)} + 1e-10) END', 'z')} FROM bars", lambda b: shown(W.zscore(b, "close", 42), "symbol", "seq", "z"))
add_bars("win_rolling_norm", f"{WITH}, s AS (SELECT *, stddev_samp(volume) {over(50)} AS sd, avg(volume) {over(50)} AS m, count(*) {over(50)} AS n FROM bars) SELECT symbol, seq, {r('CASE WHEN n < 2 OR sd < 1e-10 THEN 0.0 ELSE (volume - m) / sd END', 'norm')} FROM s", lambda b: shown(W.rolling_norm(b, "volume", 50), "symbol", "seq", "norm"))
add_bars(
    "win_expanding_moments",
    f"""{RETS}, s AS (SELECT symbol, seq, avg(ret) {over()} AS m, coalesce(var_samp(ret) {over()}, 0.0) AS v, var_pop(ret) {over()} AS vp, count(ret) {over()} AS n, skewness(ret) {over()} AS sk, kurtosis(ret) {over()} AS ku FROM b)
 SELECT symbol, seq, {r('m', 'exp_mean')}, {r('v', 'exp_var')}, {r('CASE WHEN n >= 3 AND vp >= 1e-14 THEN sk ELSE 0.0 END', 'exp_skew')}, {r('CASE WHEN n >= 4 AND vp >= 1e-14 THEN ku + 3.0 / (n - 2) ELSE 0.0 END', 'exp_kurt')} FROM s""",
    lambda b: shown(W.expanding_moments(W.returns(b), "ret"), "symbol", "seq", "exp_mean", "exp_var", "exp_skew", "exp_kurt"),
)
add_bars("win_expanding_z", f"{WITH}, s AS (SELECT *, stddev_samp(close) {over()} AS sd, avg(close) {over()} AS m, count(*) {over()} AS n FROM bars) SELECT symbol, seq, {r('CASE WHEN n < 2 OR sd < 1e-10 THEN 0.0 ELSE (close - m) / sd END', 'exp_z')} FROM s", lambda b: shown(W.expanding_z(b, "close"), "symbol", "seq", "exp_z"))
_LAGS = "wt AS (SELECT 0 AS k, CAST(1 AS DOUBLE) AS w UNION ALL SELECT k + 1, -w * (0.4 - k) / (k + 1) FROM wt WHERE abs(w * (0.4 - k) / (k + 1)) >= 1e-5)"
add_bars("win_fracdiff", f"WITH RECURSIVE {_LAGS}, {M.BARS_SQL} SELECT a.symbol, a.seq, {r('sum(w * ln(b.close))', 'fracdiff')} FROM bars a JOIN wt ON true JOIN bars b ON b.symbol = a.symbol AND b.seq = a.seq - k GROUP BY 1, 2", lambda b: shown(W.fracdiff(b), "symbol", "seq", "fracdiff"))
add_bars("win_momentum_z", f"{RETS} SELECT symbol, seq, {', '.join(r(f'(close / lag(close, {n}) {BY} - 1) / (stddev_samp(ret) {over(n)} * sqrt({n}) + 1e-10)', f'mom_z_{n}') for n in (10, 50, 250, 1000))} FROM b", lambda b: (lambda x: shown(x, "symbol", "seq", *[f"mom_z_{n}" for n in (10, 50, 250, 1000)]))(reduce(W.momentum_z, (10, 50, 250, 1000), b)))
_LIST = f"{WITH}, s AS (SELECT symbol, seq, close, list(close) {over(100)} AS v FROM bars)"
add_bars("win_pct_rank", f"{_LIST} SELECT symbol, seq, {r('CASE WHEN len(v) < 2 THEN 50.0 ELSE 100.0 * len(list_filter(v, lambda x: x < close)) / (len(v) - 1) END', 'pct_rank')} FROM s", lambda b: shown(W.percent_rank_last(b, "close"), "symbol", "seq", "pct_rank"))
add_bars(
    "win_rank_pct",
    f"""{_LIST}, t AS (SELECT symbol, seq, len(v) AS n, len(list_filter(v, lambda x: x < close)) AS lo, len(list_filter(v, lambda x: x = close)) AS eq FROM s)
 SELECT symbol, seq, {r('CASE WHEN n >= 20 THEN (lo + (eq + 1) / 2.0) / n ELSE 0.5 END', 'rank_pct')}, {r('CASE WHEN n >= 20 THEN abs((lo + lo + eq) / (2.0 * n) - 0.5) * 2 END', 'toxicity')} FROM t""",
    lambda b: shown(W.rank_pct(b, "close"), "symbol", "seq", "rank_pct", "toxicity"),
)
add_bars("win_quantile", f"{WITH} SELECT symbol, seq, {', '.join(r(f'CASE WHEN count(close) {over(start="100 PRECEDING", end="1 PRECEDING")} >= 10 THEN quantile_cont(close, {q}) {over(start="100 PRECEDING", end="1 PRECEDING")} END', f'q{int(q * 100)}') for q in (0.25, 0.95, 0.99))} FROM bars", lambda b: shown(W.lagged_quantiles(b, "close", 100), "symbol", "seq", "q25", "q95", "q99"))
add_bars("win_autocorr", f"{RETS}, s AS (SELECT *, lag(log_ret) {BY} AS p FROM b) SELECT symbol, seq, {r(f'CASE WHEN count(p) {over(19)} >= 3 THEN corr(log_ret, p) {over(19)} END', 'autocorr')} FROM s", lambda b: shown(W.autocorrelation(b), "symbol", "seq", "autocorr"))
add_bars("win_eff_ratio", f"{WITH}, s AS (SELECT *, abs(close - lag(close) {BY}) AS st FROM bars) SELECT symbol, seq, {r(f'least(greatest(abs(close - lag(close, 10) {BY}) / (sum(st) {over(10)} + 1e-10), 0.0), 1.0)', 'eff_ratio')} FROM s WHERE true", lambda b: shown(W.efficiency_ratio(b).withColumn("eff_ratio", F.when(F.col("seq") > 10, F.col("eff_ratio")).otherwise(F.least(F.greatest(F.col("eff_ratio"), F.lit(0.0)), F.lit(1.0)))), "symbol", "seq", "eff_ratio"))
add_bars(
    "win_stoch",
    f"""{WITH}, s AS (SELECT symbol, seq, close, min(low) {over(14)} AS lo, max(high) {over(14)} AS hi, count(*) {over(14)} AS n FROM bars), x AS (SELECT *, CASE WHEN n >= 14 THEN CASE WHEN hi = lo THEN 50.0 ELSE (close - lo) / (hi - lo) * 100 END END AS raw FROM s),
 k AS (SELECT *, CASE WHEN count(raw) {over(3)} >= 3 THEN avg(raw) {over(3)} END AS k FROM x) SELECT symbol, seq, {r('k', 'stoch_k')}, {r(f'CASE WHEN count(k) {over(3)} >= 3 THEN avg(k) {over(3)} END', 'stoch_d')} FROM k""",
    lambda b: shown(W.stochastic(b), "symbol", "seq", "stoch_k", "stoch_d"),
)


def _prev(f: str, x: str, n: int) -> str:
    w = over(start=f"{n} PRECEDING", end="1 PRECEDING")
    return f"CASE WHEN count({x}) {w} >= {n} THEN {f}({x}) {w} END"


add_bars("win_donchian", f"{WITH} SELECT symbol, seq, {r(_prev('max', 'high', 20), 'entry_upper')}, {r(_prev('min', 'low', 20), 'entry_lower')}, {r(_prev('max', 'high', 10), 'exit_upper')}, {r(_prev('min', 'low', 10), 'exit_lower')} FROM bars", lambda b: shown(W.donchian(b), "symbol", "seq", "entry_upper", "entry_lower", "exit_upper", "exit_lower"))
_TR = f"greatest(high - low, coalesce(abs(high - lag(close) {BY}), 0), coalesce(abs(low - lag(close) {BY}), 0))"
add_bars("win_atr", f"{WITH}, s AS (SELECT symbol, seq, {_TR} AS tr FROM bars) SELECT symbol, seq, {r('tr', 'true_range')}, {r(f'CASE WHEN count(tr) {over(14)} >= 14 THEN avg(tr) {over(14)} END', 'atr')} FROM s", lambda b: shown(W.atr(b), "symbol", "seq", "true_range", "atr"))
add_bars(
    "win_averages",
    f"{WITH} SELECT symbol, seq, {r(f'CASE WHEN count(*) {over(20)} >= 20 THEN avg(close) {over(20)} END', 'sma20')}, {r(f'avg(volume) {over(100)}', 'avg_volume')}, {r(f'avg(volume) {over(start="100 PRECEDING", end="1 PRECEDING")}', 'avg_volume_lagged')}, {r(f'avg(duration) {over(20)} / (duration + 1e-6)', 'intensity')} FROM bars",
    lambda b: shown(W.averages(b), "symbol", "seq", "sma20", "avg_volume", "avg_volume_lagged", "intensity"),
)
add_bars(
    "win_regime_bars",
    f"""{WITH}, s AS (SELECT symbol, seq, CAST(close > open AS INTEGER) AS regime FROM bars), c AS (SELECT *, CASE WHEN regime = lag(regime) {BY} THEN 0 ELSE 1 END AS ch FROM s), p AS (SELECT *, sum(ch) {over()} AS spell FROM c)
 SELECT symbol, seq, regime, CAST(spell AS BIGINT) AS spell, row_number() OVER (PARTITION BY symbol, spell ORDER BY seq) AS bars_in_regime FROM p""",
    lambda b: W.regime_spells(b, (F.col("close") > F.col("open")).cast("int")).select("symbol", "seq", "regime", "spell", F.col("bars_in_regime").cast("long").alias("bars_in_regime")),
)
_A = over(start="1 FOLLOWING", end="10 FOLLOWING")
_K = over(start="110 PRECEDING", end="11 PRECEDING")
add_bars(
    "win_mae",
    f"""{WITH}, s AS (SELECT symbol, seq, CASE WHEN count(low) {_A} = 10 THEN ln(open / min(low) {_A}) END AS l, CASE WHEN count(low) {_A} = 10 THEN ln(max(high) {_A} / open) END AS h FROM bars)
 SELECT symbol, seq, {r('l', 'mae_long')}, {r('h', 'mae_short')}, {r(f'CASE WHEN count(l) {_K} >= 10 THEN quantile_cont(l, 0.95) {_K} END', 'mae_p95')} FROM s""",
    lambda b: shown(W.adverse_excursion(b), "symbol", "seq", "mae_long", "mae_short", "mae_p95"),
)
add_bars("win_drawdown", f"{WITH} SELECT symbol, seq, {r(f'max(close) {over()}', 'peak')}, {r(f'(max(close) {over()} - close) / max(close) {over()}', 'drawdown')} FROM bars", lambda b: shown(W.drawdown(b, "close"), "symbol", "seq", "peak", "drawdown"))

# ---- recurrences ------------------------------------------------------------------------------

_ALPHA = R.alpha_of(halflife=20)
_B = 1 - _ALPHA
# a closed form: weights (1 - alpha)^age, scaled to the row, over running sums
add_bars("rec_linear", f"{WITH} SELECT symbol, seq, {r(f'pow({_B!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN close ELSE {_ALPHA!r} * close * pow({_B!r}, 1 - seq) END) {over()}', 'ewm_mean')} FROM bars", lambda b: shown(R.linear_scan(b, _ALPHA * F.col("close"), _B, "ewm_mean", F.col("close")), "symbol", "seq", "ewm_mean"))
add_bars(
    "ewm_z",
    f"""{WITH}, m AS (SELECT symbol, seq, close, pow({_B!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN close ELSE {_ALPHA!r} * close * pow({_B!r}, 1 - seq) END) {over()} AS m FROM bars),
 d AS (SELECT *, {_B!r} * {_ALPHA!r} * (close - lag(m) {BY}) * (close - lag(m) {BY}) AS d2 FROM m),
 v AS (SELECT *, pow({_B!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN 0.0 ELSE d2 * pow({_B!r}, 1 - seq) END) {over()} AS v FROM d),
 z AS (SELECT *, CASE WHEN seq = 1 OR sqrt(greatest(v, 0.0)) < 1e-10 THEN 0.0 ELSE (close - m) / sqrt(v) END AS z FROM v)
 SELECT symbol, seq, {r('m', 'ewm_mean')}, {r('v', 'ewm_var')}, {r('5 * tanh(z / 5)', 'ewm_z')}, seq >= {max(10, int(2 / _ALPHA))} AS is_primed FROM z""",
    lambda b: shown(R.ewm_z(b, "close", halflife=20), "symbol", "seq", "ewm_mean", "ewm_var", "ewm_z", "is_primed"),
)
add_bars(
    "ewm_adjusted",
    f"""{WITH}, s AS (SELECT symbol, seq, sum(pow({_B!r}, 1 - seq)) {over()} AS w, sum(pow({_B!r}, 2 - 2 * seq)) {over()} AS w2, sum(close * pow({_B!r}, 1 - seq)) {over()} AS wx, sum(close * close * pow({_B!r}, 1 - seq)) {over()} AS wxx FROM bars)
 SELECT symbol, seq, {r('wx / w', 'ewma')}, {r(f'CASE WHEN (w * w - w2) * pow({_B!r}, 2 * (seq - 1)) > 1e-12 THEN sqrt(greatest(wxx / w - pow(wx / w, 2), 0) * w * w / (w * w - w2)) END', 'ewm_std')} FROM s""",
    lambda b: shown(R.ewm_adjusted(b, "close", 20), "symbol", "seq", "ewma", "ewm_std"),
)
_RSI = 1 - 1 / 14
add_bars(
    "wilder_rsi",
    f"""{WITH}, g AS (SELECT symbol, seq, greatest(coalesce(close - lag(close) {BY}, 0), 0) AS g, greatest(-coalesce(close - lag(close) {BY}, 0), 0) AS l FROM bars),
 s AS (SELECT symbol, seq, pow({_RSI!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN g ELSE g / 14 * pow({_RSI!r}, 1 - seq) END) {over()} AS up, pow({_RSI!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN l ELSE l / 14 * pow({_RSI!r}, 1 - seq) END) {over()} AS dn FROM g)
 SELECT symbol, seq, {r('CASE WHEN up < 1e-10 AND dn < 1e-10 THEN 50.0 WHEN dn < 1e-10 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END', 'rsi')} FROM s""",
    lambda b: shown(R.wilder_rsi(b, "close", 14), "symbol", "seq", "rsi"),
)
_DAILY = f"""{M.TRADES_SQL}, daily AS (SELECT symbol, CAST(ts AS DATE) AS day, sum(quote_qty) AS day_quote FROM trades GROUP BY 1, 2), dn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS seq FROM daily),
 st AS (SELECT *, avg(CASE WHEN seq <= 14 THEN day_quote END) OVER (PARTITION BY symbol) AS s0 FROM dn), em AS (SELECT *, CASE WHEN seq >= 14 THEN pow(13.0 / 15, seq - 14) * sum(CASE WHEN seq = 14 THEN s0 WHEN seq > 14 THEN 2.0 / 15 * day_quote * pow(13.0 / 15, 14 - seq) ELSE 0.0 END) {over()} ELSE 0.0 END AS ema FROM st),
 thr AS (SELECT symbol, day, seq AS day_no, day_quote, CASE WHEN seq > 14 THEN lag(ema) {BY} / 8 END AS threshold FROM em)"""
register("ema_threshold", f"WITH {_DAILY} SELECT symbol, day, day_no, {r('day_quote', 'day_quote')}, {r('threshold', 'threshold')} FROM thr")(lambda spark, d: shown(R.daily_threshold(M.trades(spark, d), 8), "symbol", "day", F.col("day_no").cast("long").alias("day_no"), "day_quote", "threshold"))
register("agg_daily_quote", f"WITH {_DAILY} SELECT symbol, day, {r('day_quote', 'day_quote')} FROM daily")(lambda spark, d: shown(M.trades(spark, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("quote_qty").alias("day_quote")), "symbol", "day", "day_quote"))
BAR_COLUMNS = "start_time end_time open high high_time low low_time close volume dollar_value tick_count buy_dollar_vol duration sell_dollar_vol net_imbalance".split()


def _bars_of(ids: str) -> str:
    buy = "sum(CASE WHEN is_aggressor_buy THEN quote_qty ELSE 0.0 END)"
    return f"""SELECT symbol, bar_id, min(ts_ms) AS start_time, max(ts_ms) AS end_time, {r('arg_min(price, trade_id)', 'open')}, {r('max(price)', 'high')}, first(ts_ms ORDER BY price DESC, trade_id) AS high_time, {r('min(price)', 'low')}, first(ts_ms ORDER BY price, trade_id) AS low_time,
 {r('arg_max(price, trade_id)', 'close')}, {r('sum(qty)', 'volume')}, {r('sum(quote_qty)', 'dollar_value')}, count(*) AS tick_count, {r(buy, 'buy_dollar_vol')}, {r('greatest((max(ts_ms) - min(ts_ms)) / 1000.0, 0.001)', 'duration')}, {r(f'sum(quote_qty) - {buy}', 'sell_dollar_vol')}, {r(f'2 * {buy} - sum(quote_qty)', 'net_imbalance')} FROM {ids} GROUP BY symbol, bar_id"""


register(
    "dollar_bars_cum",
    f"""WITH {_DAILY}, j AS (SELECT t.*, CAST(t.ts AS DATE) AS day, threshold FROM trades t JOIN thr ON t.symbol = thr.symbol AND CAST(t.ts AS DATE) = thr.day WHERE threshold IS NOT NULL),
 ids AS (SELECT *, datediff('day', DATE '1970-01-01', day) * 100000 + CAST(floor(coalesce(sum(quote_qty) OVER (PARTITION BY symbol, day ORDER BY trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / threshold) AS BIGINT) AS bar_id FROM j) {_bars_of('ids')}""",
)(lambda spark, d: shown(R.aggregate_bars(R.dollar_bar_ids(t := M.trades(spark, d), R.daily_threshold(t, 8), exact=False)), "symbol", "bar_id", *BAR_COLUMNS))
register(
    "dollar_bars",
    f"""WITH RECURSIVE {_DAILY}, j AS (SELECT t.*, threshold, row_number() OVER (PARTITION BY t.symbol ORDER BY trade_id) AS n FROM trades t JOIN thr ON t.symbol = thr.symbol AND CAST(t.ts AS DATE) = thr.day WHERE threshold IS NOT NULL),
 walk AS (SELECT symbol, n, quote_qty AS acc, threshold, 0 AS bar_id, false AS closed FROM j WHERE n = 1 UNION ALL
  SELECT j.symbol, j.n, CASE WHEN w.acc >= w.threshold - 1e-9 THEN 0.0 ELSE w.acc END + j.quote_qty, j.threshold, CASE WHEN w.acc >= w.threshold - 1e-9 THEN w.bar_id + 1 ELSE w.bar_id END, false FROM walk w JOIN j ON j.symbol = w.symbol AND j.n = w.n + 1),
 ids AS (SELECT j.*, CAST(w.bar_id AS BIGINT) AS bar_id FROM j JOIN walk w ON w.symbol = j.symbol AND w.n = j.n) {_bars_of('ids')}""",
)(lambda spark, d: shown(R.aggregate_bars(R.dollar_bar_ids(t := M.trades(spark, d), R.daily_threshold(t, 8))), "symbol", "bar_id", *BAR_COLUMNS))
TIB_COLUMNS = ("open", "high", "low", "close", "volume", "tick_count")
register(
    "tib_bars",
    f"""WITH RECURSIVE {M.TRADES_SQL}, s0 AS (SELECT *, row_number() OVER w AS n, sign(price - lag(price) OVER w) AS d FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY trade_id)),
 s AS (SELECT *, CAST(coalesce(last_value(nullif(d, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS INTEGER) AS tick FROM s0),
 walk AS (SELECT symbol, n, tick AS acc, 0 AS bar_id FROM s WHERE n = 1 UNION ALL SELECT s.symbol, s.n, CASE WHEN abs(w.acc) >= {50 * abs(2 * 0.6 - 1)!r} THEN 0 ELSE w.acc END + s.tick, CASE WHEN abs(w.acc) >= {50 * abs(2 * 0.6 - 1)!r} THEN w.bar_id + 1 ELSE w.bar_id END FROM walk w JOIN s ON s.symbol = w.symbol AND s.n = w.n + 1),
 o AS (SELECT s.*, CAST(w.bar_id AS BIGINT) AS bar_id FROM s JOIN walk w ON w.symbol = s.symbol AND w.n = s.n)
 SELECT symbol, bar_id, min(ts_ms) AS timestamp, {r('arg_min(price, trade_id)', 'open')}, {r('max(price)', 'high')}, {r('min(price)', 'low')}, {r('arg_max(price, trade_id)', 'close')}, {r('sum(qty)', 'volume')}, count(*) AS tick_count FROM o GROUP BY 1, 2""",
)(
    lambda spark, d: shown(
        R.tib_bar_ids(M.trades(spark, d), 50, 0.6).groupBy("symbol", "bar_id").agg(F.min("ts_ms").alias("timestamp"), F.min_by("price", "trade_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "trade_id").alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("tick_count")),
        "symbol", "bar_id", "timestamp", *TIB_COLUMNS,
    )
)


def ruled(b: DataFrame) -> DataFrame:
    """Bars with what rules read: a trend and its forecast, velocity, uncertainty, oscillator, channel and z-score."""
    b = W.zscore(W.donchian(W.stochastic(W.averages(W.returns(b)))), "close", 42)
    w = W.by_seq()
    b = b.withColumns({"fast": F.avg("close").over(W.last_rows(5)), "tr": F.coalesce("sma20", "close"), "u": F.coalesce(F.var_samp("close").over(W.last_rows(20)), F.lit(1.0))})
    b = b.withColumn("v", F.coalesce(F.col("tr") - F.lag("tr").over(w), F.lit(0.0)))
    return b.withColumn("tp", F.col("tr") + F.col("v"))


_RULED = f"""{WITH}, a AS (SELECT *, coalesce(CASE WHEN count(*) {over(20)} >= 20 THEN avg(close) {over(20)} END, close) AS tr, coalesce(var_samp(close) {over(20)}, 1.0) AS u, avg(close) {over(5)} AS fast, {_prev('max', 'high', 20)} AS eu, {_prev('min', 'low', 20)} AS el, {_prev('max', 'high', 10)} AS xu, {_prev('min', 'low', 10)} AS xl,
  min(low) {over(14)} AS lo, max(high) {over(14)} AS hi, count(*) {over(14)} AS nk FROM bars),
 v0 AS (SELECT *, coalesce(tr - lag(tr) {BY}, 0.0) AS v, tr + coalesce(tr - lag(tr) {BY}, 0.0) AS tp, lag(close) {BY} AS pc, coalesce(lag(u) {BY}, 1.0) AS pu, fast - tr AS gap, lag(fast - tr) {BY} AS pgap, CASE WHEN nk >= 14 THEN CASE WHEN hi = lo THEN 50.0 ELSE (close - lo) / (hi - lo) * 100 END END AS raw FROM a),
 v AS (SELECT *, CASE WHEN count(raw) {over(3)} >= 3 THEN avg(raw) {over(3)} END AS sk FROM v0)"""
_TREND = ("close < tr", "close > tr")
_RULES_SQL = {
    "breakout": ("close > tr + sqrt(u)", "close < tr - sqrt(u)", *_TREND),
    "fused": ("tp > pc + sqrt(pu) AND v > 0", "tp < pc - sqrt(pu) AND v < 0", *_TREND),
    "scalp": ("v / close > 0.0005", "v / close < -0.0005", "v < 0", "v > 0"),
    "v2_breakout": ("close > tr + u AND v > 0", "close < tr - u AND v < 0", *_TREND),
    "v2_predictive": ("tp > pc + pu", "tp < pc - pu", "false", "false"),
    "v2_triple": ("tp > pc + pu AND v > 0", "tp < pc - pu AND v < 0", *_TREND),
    "v3_breakout_rev": ("close > tr + sqrt(u)", "close < tr - sqrt(u)", *_TREND),
    "v3_predictive_rev": ("tp > pc + sqrt(u)", "tp < pc - sqrt(u)", "false", "false"),
    "v3_fused_rev": ("tp > pc + sqrt(u) AND v > 0", "tp < pc - sqrt(u) AND v < 0", *_TREND),
    "mean_reversion": ("close < tr - sqrt(u)", "close > tr + sqrt(u)", "close > tr", "close < tr"),
    "mr_tight": ("close < tr - sqrt(u)", "close > tr + sqrt(u)", "close > tr - 0.5 * sqrt(u)", "close < tr + 0.5 * sqrt(u)"),
    "mr_reversal": ("close < tr - sqrt(u)", "close > tr + sqrt(u)", "close > tr", "close < tr"),
    "osc_basic": ("tp > pc + sqrt(u) AND sk < 80", "tp < pc - sqrt(u) AND sk > 20", "false", "false"),
    "osc_exit": ("tp > pc + sqrt(u) AND sk < 80", "tp < pc - sqrt(u) AND sk > 20", "close > tr", "close < tr"),
    "osc_fade": ("sk < 20 AND tp > pc", "sk > 80 AND tp < pc", "sk > 50", "sk < 50"),
    "crossover": ("gap > 0 AND pgap <= 0 AND v > 0", "gap < 0 AND pgap >= 0 AND v < 0", "gap < 0 AND pgap >= 0", "gap > 0 AND pgap <= 0"),
    "channel": ("close > eu", "close < el", "close < xl", "close > xu"),
}
_FRESH = "CASE WHEN el THEN 1 WHEN es THEN -1 ELSE 0 END"


def _held(held: int, policy: str) -> str:
    """The next position of a held one, as a loop over bars would say it."""
    leave, other = ("xl", "es") if held > 0 else ("xs", "el")
    turned = f"CASE WHEN {other} THEN {-held} ELSE 0 END"
    gone = {"a": "0", "d": "0", "b": turned, "bd": turned, "e": str(-held), "f": _FRESH}
    exits = "" if policy in ("c", "switch") else f"WHEN {leave} THEN {gone[policy]} "
    turns = "" if policy in ("a", "b") else f"WHEN {other} THEN {-held} "
    return f"CASE {exits}{turns}ELSE {held} END" if exits or turns else str(held)


for _name, (_el, _es, _xl, _xs) in _RULES_SQL.items():
    _rule, _policy = U.POLICIES[_name]
    register(
        f"rule_{_name}",
        f"""WITH RECURSIVE {_RULED.removeprefix('WITH ')}, f AS (SELECT symbol, seq, coalesce({_el}, false) AS el, coalesce({_es}, false) AS es, coalesce({_xl}, false) AS xl, coalesce({_xs}, false) AS xs FROM v),
 walk AS (SELECT symbol, seq, {_FRESH} AS position FROM f WHERE seq = 1 UNION ALL
  SELECT f.symbol, f.seq, CASE WHEN w.position = 1 THEN {_held(1, _policy)} WHEN w.position = -1 THEN {_held(-1, _policy)} ELSE {_FRESH} END FROM walk w JOIN f ON f.symbol = w.symbol AND f.seq = w.seq + 1)
 SELECT symbol, seq, position FROM walk""",
    )(bars(lambda b, f=_rule, p=_policy: (R.switch(ruled(b), *list(f().values())[:2]) if p == "switch" else R.latch(ruled(b), *f().values(), policy=p)).select("symbol", "seq", "position")))
# a signal for the other side switches at once, so the last signal is the position
register(
    "rule_predictive",
    f"""{_RULED}, f AS (SELECT symbol, seq, CASE WHEN tr + v > pc + sqrt(pu) THEN 1 WHEN tr + v < pc - sqrt(pu) THEN -1 END AS e FROM v)
 SELECT symbol, seq, coalesce(last_value(e IGNORE NULLS) {over()}, 0) AS position FROM f""",
)(bars(lambda b: R.switch(ruled(b), *[U.RULES["predictive"]()[x] for x in ("enter_long", "enter_short")]).select("symbol", "seq", "position")))

# ---- labels, ledger, equity -------------------------------------------------------------------

_TBM = f"""{RETS}, s AS (SELECT *, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS sigma, max(seq) OVER (PARTITION BY symbol) AS n FROM b),
 a AS (SELECT symbol, seq, close AS entry, close * (1 + 0.3 * sigma * sqrt(12.0)) AS up, close * (1 - 0.3 * sigma * sqrt(12.0)) AS dn FROM s WHERE seq + 12 <= n AND sigma > 0),
 p AS (SELECT a.*, b2.seq AS bs, b2.close AS bc, b2.high >= up AS hu, b2.low <= dn AS hd FROM a JOIN bars b2 ON b2.symbol = a.symbol AND b2.seq > a.seq AND b2.seq <= a.seq + 12),
 h AS (SELECT symbol, seq, any_value(entry) AS entry, any_value(up) AS up, any_value(dn) AS dn, min(bs) FILTER (hu OR hd) AS hit_at, arg_min(hu, bs) FILTER (hu OR hd) AS hu, arg_min(hd, bs) FILTER (hu OR hd) AS hd, arg_min(bc, bs) FILTER (hu OR hd) AS hc, arg_max(bc, bs) AS ec, max(bs) AS es FROM p GROUP BY 1, 2),
 l AS (SELECT *, CASE WHEN hit_at IS NULL THEN 0 WHEN hu AND hd THEN CAST(sign(hc - entry) AS INTEGER) WHEN hu THEN 1 ELSE -1 END AS label FROM h)"""
_TBM_OUT = f"SELECT symbol, seq, label, {r('CASE WHEN hit_at IS NULL THEN ec WHEN label = 1 THEN up WHEN label = -1 THEN dn ELSE hc END / entry - 1', 'ret')}, coalesce(hit_at, es) AS exit_seq FROM l"


def tbm(b: DataFrame) -> DataFrame:
    return L.first_touch(W.volatility(b), "realized_vol", 0.3, 0.3, 12)


add_bars("lab_tbm", f"{_TBM} {_TBM_OUT}", lambda b: shown(tbm(b), "symbol", "seq", "label", "ret", F.col("exit_seq").cast("long").alias("exit_seq")))
add_bars("agg_label_dist", f"{_TBM}, c AS (SELECT symbol, label, count(*) AS n FROM l GROUP BY 1, 2) SELECT symbol, label, n, {r('n * 1.0 / sum(n) OVER (PARTITION BY symbol)', 'share')} FROM c", lambda b: shown(tbm(b).groupBy("symbol", "label").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))), "symbol", "label", "n", "share"))
add_bars("agg_entropy", f"{_TBM}, c AS (SELECT symbol, label, count(*) AS n FROM l GROUP BY 1, 2), sh AS (SELECT symbol, n * 1.0 / sum(n) OVER (PARTITION BY symbol) AS p FROM c) SELECT symbol, {r('-sum(p * ln(p))', 'entropy')} FROM sh GROUP BY 1", lambda b: shown(tbm(b).groupBy("symbol", "label").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("symbol"))).groupBy("symbol").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy")), "symbol", "entropy"))
add_bars("agg_class_weights", f"{_TBM}, c AS (SELECT symbol, label, count(*) AS n FROM l GROUP BY 1, 2) SELECT symbol, label, {r('least(greatest(sum(n) OVER (PARTITION BY symbol) / (3.0 * n), 0.1), 10.0)', 'weight')} FROM c", lambda b: shown(tbm(b).groupBy("symbol", "label").agg(F.count("*").alias("n")).withColumn("weight", F.least(F.greatest(F.sum("n").over(Window.partitionBy("symbol")) / (3.0 * F.col("n")), F.lit(0.1)), F.lit(10.0))), "symbol", "label", "weight"))


@register(
    "lab_grid",
    f"""{RETS}, s AS (SELECT *, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS sigma, max(seq) OVER (PARTITION BY symbol) AS n FROM b), hz AS (SELECT unnest([50, 100, 200, 500, 1000]) AS hz),
 a AS (SELECT symbol, seq, hz, close AS entry, sigma * sqrt(CAST(hz AS DOUBLE)) AS u FROM s, hz WHERE seq + hz <= n AND sigma > 0),
 p AS (SELECT a.*, b2.seq AS bs, b2.close AS bc, b2.high AS bh, b2.low AS bl FROM a JOIN bars b2 ON b2.symbol = a.symbol AND b2.seq > a.seq AND b2.seq <= a.seq + hz),
 h AS (SELECT symbol, seq, hz, entry, {', '.join(f'min(bs) FILTER (bh >= entry * (1 + {x} * u)) AS u{i}, arg_min(bc, bs) FILTER (bh >= entry * (1 + {x} * u)) AS c{i}' for i, x in enumerate((1.5, 2.0, 2.5, 3.0, 3.5)))}, {', '.join(f'min(bs) FILTER (bl <= entry * (1 - {x} * u)) AS d{i}' for i, x in enumerate((1.0, 2.0, 3.0)))} FROM p GROUP BY 1, 2, 3, 4),
 l AS ({' UNION ALL '.join(f'SELECT symbol, CAST({sl} AS DOUBLE) AS sl, CAST({pt} AS DOUBLE) AS pt, hz, CASE WHEN u{m} = d{k} THEN CAST(sign(c{m} - entry) AS INTEGER) WHEN u{m} IS NOT NULL AND (d{k} IS NULL OR u{m} < d{k}) THEN 1 WHEN d{k} IS NOT NULL THEN -1 ELSE 0 END AS label FROM h' for k, sl in enumerate((1.0, 2.0, 3.0)) for m, pt in enumerate((1.5, 2.0, 2.5, 3.0, 3.5)))})
 SELECT symbol, sl, pt, CAST(hz AS INTEGER) AS horizon, count(*) AS n, count(*) FILTER (label = 1) AS ups, count(*) FILTER (label = -1) AS downs FROM l GROUP BY 1, 2, 3, 4""",
)
def lab_grid(spark: SparkSession, d: str) -> DataFrame:
    """Labels for each stop, target and horizon of the grid: one job for each point would scan the bars as often, so levels ride along as arrays."""
    found = L.touch_grid(W.volatility(M.bars(spark, d)), "realized_vol", [1.0, 2.0, 3.0], [1.5, 2.0, 2.5, 3.0, 3.5], [50, 100, 200, 500, 1000])
    return found.groupBy("symbol", "sl", "pt", "horizon").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("ups"), F.count_if(F.col("label") == -1).alias("downs"))


add_bars(
    "join_forward_range",
    f"{WITH} SELECT a.symbol, a.seq, count(*) AS n, {r('max(b.high)', 'high')}, {r('min(b.low)', 'low')} FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.seq > a.seq AND b.seq <= a.seq + 20 GROUP BY 1, 2",
    lambda b: shown(L.forward_pairs(b.select("symbol", "seq"), b.select("symbol", "seq", "high", "low"), 20).groupBy("symbol", "seq").agg(F.count("*").alias("n"), F.max("b.high").alias("high"), F.min("b.low").alias("low")), "symbol", "seq", "n", "high", "low"),
)
add_bars("join_next_bar", f"{WITH} SELECT symbol, seq, {r(f'lead(open) {BY}', 'next_open')} FROM bars", lambda b: shown(b.withColumn("next_open", F.lead("open").over(W.by_seq())), "symbol", "seq", "next_open"))
add_bars(
    "join_asof_time",
    f"{WITH} SELECT a.symbol, a.seq, coalesce(min(b.seq), max(a.n)) AS vertical FROM (SELECT *, max(seq) OVER (PARTITION BY symbol) AS n FROM bars) a LEFT JOIN bars b ON a.symbol = b.symbol AND b.bar_ts >= a.bar_ts + INTERVAL 48 HOUR GROUP BY 1, 2",
    # the bars that start before ts + 48 hours are counted by a range frame, so there is no join
    lambda b: b.select("symbol", "seq", F.least(F.col("seq") + F.count("*").over(Window.partitionBy("symbol").orderBy(F.unix_seconds("bar_ts")).rangeBetween(0, 48 * 3600 - 1)), F.max("seq").over(Window.partitionBy("symbol"))).cast("long").alias("vertical")),
)


@register(
    "join_asof_ffill",
    f"""WITH daily AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS symbol, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), k AS (SELECT * FROM (SELECT DISTINCT day FROM daily), (SELECT DISTINCT symbol FROM daily)),
 j AS (SELECT k.symbol, k.day, v FROM k LEFT JOIN daily USING (symbol, day)) SELECT symbol, day, {r("coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 100000.0)", 'value')} FROM j""",
)
def join_asof_ffill(spark: SparkSession, d: str) -> DataFrame:
    daily = M.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("symbol")).agg(F.sum("o_totalprice").alias("v"))
    # each series is carried over the union of all days: one row for each series and day
    days = daily.select("day").distinct()
    series = daily.select("symbol").distinct()
    rows = series.crossJoin(days).join(daily, ["symbol", "day"], "left")
    w = Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return shown(rows.withColumn("value", F.coalesce(F.last("v", ignorenulls=True).over(w), F.lit(100000.0))), "symbol", "day", "value")


register("join_inner_dates", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS s FROM orders) SELECT day FROM d GROUP BY day HAVING count(*) = (SELECT count(DISTINCT s) FROM d)")(
    lambda spark, d: (lambda o: o.groupBy("day").agg(F.count("*").alias("n")).join(o.agg(F.countDistinct("s").alias("m")), F.expr("n = m")).select("day"))(M.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("s")).distinct())
)
_FOLDS = f"{WITH}, e AS (SELECT symbol, min(CAST(bar_ts AS DATE)) AS a, max(CAST(bar_ts AS DATE)) AS z FROM bars GROUP BY 1), f AS (SELECT symbol, a, unnest(range(CAST(floor((datediff('day', a, z) + 1 - 15) / 5.0) AS BIGINT) + 1)) AS fold FROM e)"
add_bars(
    "join_folds",
    f"""{_FOLDS} SELECT f.symbol, CAST(fold AS INTEGER) AS fold, count(*) FILTER (CAST(bar_ts AS DATE) < a + CAST(fold * 5 + 10 AS INTEGER)) AS n_train, count(*) FILTER (CAST(bar_ts AS DATE) >= a + CAST(fold * 5 + 10 AS INTEGER)) AS n_test FROM f JOIN bars b ON b.symbol = f.symbol
 AND CAST(bar_ts AS DATE) >= a + CAST(fold * 5 AS INTEGER) AND CAST(bar_ts AS DATE) < a + CAST(fold * 5 + 15 AS INTEGER) GROUP BY 1, 2""",
    lambda b: (lambda days, folds: days.join(folds, "symbol").where("day >= train_start AND day < test_end").groupBy("symbol", "fold").agg(F.count_if(F.expr("day < train_end")).alias("n_train"), F.count_if(F.expr("day >= test_start")).alias("n_test")))(days := b.select("symbol", F.to_date("bar_ts").alias("day")), L.rolling_folds(days, 10, 5, 5)),
)
add_bars("split_temporal", f"{WITH}, c AS (SELECT symbol, seq, floor(count(*) OVER (PARTITION BY symbol) * (1 - 0.2)) AS cutoff FROM bars) SELECT symbol, CASE WHEN seq > cutoff THEN 'test' WHEN seq > cutoff - least(24, floor(cutoff / 2)) THEN 'purge' ELSE 'train' END AS part, count(*) AS n FROM c GROUP BY 1, 2", lambda b: L.split_temporal(b, 0.2, 24).groupBy("symbol", "part").agg(F.count("*").alias("n")))
add_bars("lab_vol_regime", f"{RETS}, s AS (SELECT symbol, seq, CASE WHEN seq > 1 THEN abs(log_ret) END AS x FROM b), q AS (SELECT symbol, quantile_cont(x, 0.33) AS a, quantile_cont(x, 0.66) AS z FROM s GROUP BY 1) SELECT s.symbol, seq, CASE WHEN x IS NULL THEN 'unknown' WHEN x <= a THEN 'low' WHEN x <= z THEN 'medium' ELSE 'high' END AS vol_regime FROM s JOIN q USING (symbol)", lambda b: L.terciles(W.returns(b).withColumn("x", F.abs("log_ret")), "x").select("symbol", "seq", "vol_regime"))
add_bars("lab_volume_ratio", f"{WITH} SELECT symbol, seq, {r(f'ln(1 + volume) / avg(ln(1 + volume)) {over(start="100 PRECEDING", end="1 PRECEDING")}', 'volume_ratio')} FROM bars", lambda b: shown(b.withColumn("lv", F.log1p("volume")).withColumn("volume_ratio", F.col("lv") / F.avg("lv").over(W.previous_rows(100))), "symbol", "seq", "volume_ratio"))
add_bars("win_context", f"{WITH}, s AS (SELECT symbol, seq, list(close) {over(start="24 PRECEDING", end="1 PRECEDING")} AS v FROM bars) SELECT symbol, seq, {r('list_sum(v)', 'total')} FROM s WHERE len(v) = 24", lambda b: shown(L.context_windows(b, ["close"], 24).withColumn("total", F.aggregate("context", F.lit(0.0), lambda a, x: a + x["close"])), "symbol", "seq", "total"))
register("lab_trend_scan")(bars(lambda b: shown(L.trend_scan(b, list(range(20, 101))), "symbol", "seq", "window", "t_value", "label")))
_SIG = f"{WITH}, g AS (SELECT symbol, seq, close, CASE WHEN close > avg(close) {over(20)} THEN 1 ELSE -1 END AS sig FROM bars)"


def signalled(b: DataFrame) -> DataFrame:
    return b.withColumn("sig", F.when(F.col("close") > F.avg("close").over(W.last_rows(20)), 1).otherwise(-1))


_LED = f"""{_SIG}, c AS (SELECT *, CASE WHEN sig = lag(sig) {BY} THEN 0 ELSE 1 END AS ch, lead(close) {BY} AS nc, lead(seq) {BY} AS ns FROM g), p AS (SELECT *, sum(ch) {over()} AS sp FROM c),
 led AS (SELECT symbol, sp, min(seq) AS entry_seq, arg_min(close, seq) AS entry_price, coalesce(max(ns), max(seq)) AS exit_seq, arg_max(coalesce(nc, close), seq) AS exit_price, any_value(sig) AS direction, count(*) AS holding_bars FROM p GROUP BY 1, 2),
 led2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_seq) AS trade_no, direction * (exit_price / entry_price - 1) AS gross_pnl FROM led)"""
add_bars("led_from_signal", f"{_LED} SELECT symbol, trade_no, entry_seq, exit_seq, direction, {r('entry_price', 'entry_price')}, {r('exit_price', 'exit_price')}, {r('gross_pnl', 'gross_pnl')}, holding_bars FROM led2", lambda b: shown(L.spell_trades(signalled(b), "sig"), "symbol", F.col("trade_no").cast("long").alias("trade_no"), F.col("entry_seq").cast("long").alias("entry_seq"), F.col("exit_seq").cast("long").alias("exit_seq"), "direction", "entry_price", "exit_price", "gross_pnl", "holding_bars"))
add_bars(
    "agg_ledger",
    f"{_LED} SELECT symbol, count(*) AS n, {r('avg(CASE WHEN gross_pnl > 0 THEN 1.0 ELSE 0.0 END)', 'win_rate')}, {r('avg(gross_pnl)', 'avg_pnl')}, {r('avg(holding_bars)', 'avg_hold')}, {r('sum(greatest(gross_pnl, 0.0))', 'gross_profit')}, {r('-sum(least(gross_pnl, 0.0))', 'gross_loss')}, {r('sum(gross_pnl) / sum(holding_bars)', 'expectancy')} FROM led2 GROUP BY 1",
    lambda b: shown(L.spell_trades(signalled(b), "sig").groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("gross_pnl") > 0).cast("double")).alias("win_rate"), F.avg("gross_pnl").alias("avg_pnl"), F.avg("holding_bars").alias("avg_hold"), F.sum(F.greatest("gross_pnl", F.lit(0.0))).alias("gross_profit"), (-F.sum(F.least("gross_pnl", F.lit(0.0)))).alias("gross_loss"), (F.sum("gross_pnl") / F.sum("holding_bars")).alias("expectancy")), "symbol", "n", "win_rate", "avg_pnl", "avg_hold", "gross_profit", "gross_loss", "expectancy"),
)
add_bars(
    "agg_trade_quality",
    f"{_LED} SELECT symbol, direction, count(*) AS n, {r('sum(gross_pnl)', 'pnl')} FROM led2 GROUP BY GROUPING SETS ((symbol), (symbol, direction))",
    lambda b: shown(L.spell_trades(signalled(b), "sig").groupingSets([["symbol"], ["symbol", "direction"]], "symbol", "direction").agg(F.count("*").alias("n"), F.sum("gross_pnl").alias("pnl")), "symbol", "direction", "n", "pnl"),
)
_EQ = f"{_SIG}, h AS (SELECT *, coalesce(lag(sig) {BY}, 0) * coalesce(close / lag(close) {BY} - 1, 0.0) - 0.0004 * abs(sig - coalesce(lag(sig) {BY}, 0)) AS pnl FROM g), q AS (SELECT h.*, sum(ln(greatest(1 + pnl, 1e-12))) {over()} AS log_growth, 100000.0 * exp(sum(ln(greatest(1 + pnl, 1e-12))) {over()}) AS equity FROM h)"


def equity(b: DataFrame) -> DataFrame:
    return L.equity_curve(signalled(b), "sig")


add_bars("eq_curve", f"{_EQ} SELECT symbol, seq, {r('pnl', 'bar_pnl')}, {r('log_growth', 'log_growth')} FROM q", lambda b: shown(equity(b), "symbol", "seq", "bar_pnl", "log_growth"))
add_bars("agg_mdd", f"{_EQ}, k AS (SELECT *, max(equity) {over()} AS pk FROM q) SELECT symbol, {r('max((pk - equity) / pk)', 'mdd')} FROM k GROUP BY 1", lambda b: shown(W.drawdown(equity(b), "equity").groupBy("symbol").agg(F.max("drawdown").alias("mdd")), "symbol", "mdd"))
add_bars(
    "agg_sharpe",
    f"""{_EQ}, d AS (SELECT q.symbol, CAST(b.bar_ts AS DATE) AS day, arg_max(equity, q.seq) AS e FROM q JOIN bars b ON b.symbol = q.symbol AND b.seq = q.seq GROUP BY 1, 2), x AS (SELECT symbol, e / nullif(lag(e) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS x FROM d)
 SELECT symbol, {r('avg(x) / nullif(stddev_pop(x), 0) * sqrt(252)', 'sharpe')}, {r('avg(x) / nullif(sqrt(sum(CASE WHEN x < 0 THEN x * x ELSE 0 END) / nullif(count(x), 0)), 0) * sqrt(252)', 'sortino')} FROM x GROUP BY 1""",
    lambda b: shown(
        equity(b).groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.max_by("equity", "seq").alias("e")).withColumn("x", F.try_divide("e", F.lag("e").over(Window.partitionBy("symbol").orderBy("day"))) - 1).groupBy("symbol").agg((F.try_divide(F.avg("x"), F.stddev_pop("x")) * math.sqrt(252)).alias("sharpe"), (F.try_divide(F.avg("x"), F.sqrt(F.try_divide(F.sum(F.when(F.col("x") < 0, F.col("x") * F.col("x")).otherwise(0.0)), F.count("x")))) * math.sqrt(252)).alias("sortino")),
        "symbol", "sharpe", "sortino",
    ),
)
add_bars("agg_signal_stats", f"{_SIG}, c AS (SELECT *, lag(sig) {BY} AS p FROM g) SELECT symbol, count(*) AS n, count(*) FILTER (sig = 1) AS longs, count(*) FILTER (sig <> p) AS changes FROM c GROUP BY 1", lambda b: signalled(b).withColumn("p", F.lag("sig").over(W.by_seq())).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("sig") == 1).alias("longs"), F.count_if(F.col("sig") != F.col("p")).alias("changes")))

add_bars(
    "lab_sniper",
    f"""{RETS}, s AS (SELECT *, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS sigma, max(seq) OVER (PARTITION BY symbol) AS n FROM b), a AS (SELECT symbol, seq, close AS entry, sigma FROM s WHERE seq + 18 < n AND sigma > 0),
 h AS (SELECT a.symbol, a.seq, any_value(sigma) AS sigma, min(k.seq) FILTER (k.high >= entry * (1 + 2.0 * sigma)) AS u, min(k.seq) FILTER (k.low <= entry * (1 - 1.5 * sigma)) AS d FROM a JOIN bars k ON k.symbol = a.symbol AND k.seq > a.seq AND k.seq <= a.seq + 18 GROUP BY 1, 2)
 SELECT symbol, seq, CASE WHEN 2.0 * sigma < 0.0045 THEN 0 WHEN u <= coalesce(d, u) THEN 1 WHEN d IS NOT NULL THEN -1 ELSE 0 END AS label FROM h""",
    lambda b: L.sniper_labels(W.volatility(b), "realized_vol"),
)
# the trades of all signals; then those taken with one open at a time
_CAND = f"""{RETS.removeprefix('WITH ')}, s AS (SELECT *, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS rv, CASE WHEN close > avg(close) {over(20)} THEN 1 ELSE -1 END AS sig FROM b),
 e AS (SELECT symbol, lead(seq) {BY} AS es, sig, lead(open) {BY} * (1 + sig * 0.0001) AS ep, CASE WHEN rv > 0 THEN rv ELSE 0.001 END AS sg FROM s), e2 AS (SELECT *, ep * (1 + sig * 2.0 * sg) AS tp, ep * (1 - sig * 1.0 * sg) AS sl FROM e WHERE es IS NOT NULL),
 pr AS (SELECT e2.*, k.seq AS ks, k.close AS kc, CASE WHEN sig > 0 THEN k.low <= sl ELSE k.high >= sl END AS st, CASE WHEN sig > 0 THEN k.high >= tp ELSE k.low <= tp END AS tg FROM e2 JOIN bars k ON k.symbol = e2.symbol AND k.seq > es AND k.seq <= es + 24),
 hh AS (SELECT symbol, es, sig, ep, tp, sl, min(ks) FILTER (st OR tg) AS hs, arg_min(st, ks) FILTER (st OR tg) AS st, max(ks) AS xe, arg_max(kc, ks) AS xc FROM pr GROUP BY ALL),
 cand AS (SELECT symbol, es AS entry_seq, coalesce(hs, xe) AS exit_seq, sig AS direction, ep AS entry_price, (CASE WHEN hs IS NULL THEN xc WHEN st THEN sl ELSE tp END) * (1 - sig * 0.0001) AS exit_price, CASE WHEN hs IS NULL THEN 'TIMEOUT' WHEN st THEN 'SL' ELSE 'TP' END AS reason FROM hh),
 led AS (SELECT *, direction * (exit_price - entry_price) / entry_price - 0.0008 AS pnl FROM cand)"""
_CHAIN = f"""WITH RECURSIVE {_CAND}, nx AS (SELECT c.*, (SELECT min(d.entry_seq) FROM led d WHERE d.symbol = c.symbol AND d.entry_seq > c.exit_seq) AS nxt FROM led c),
 ch AS (SELECT * FROM nx WHERE entry_seq = (SELECT min(z.entry_seq) FROM led z WHERE z.symbol = nx.symbol) UNION ALL SELECT nx.* FROM ch JOIN nx ON nx.symbol = ch.symbol AND nx.entry_seq = ch.nxt)"""
_TRADE = ("symbol", "entry_seq", "exit_seq", "direction", "entry_price", "exit_price", "reason", "pnl")
_TRADE_SQL = f"symbol, entry_seq, exit_seq, direction, {r('entry_price', 'entry_price')}, {r('exit_price', 'exit_price')}, reason, {r('pnl', 'pnl')}"


def barrier_ledger(b: DataFrame) -> DataFrame:
    return L.barrier_trades(signalled(W.volatility(b)), "sig", "realized_vol")


add_bars("led_exit_barrier", f"WITH {_CAND} SELECT {_TRADE_SQL} FROM led", lambda b: shown(barrier_ledger(b), *_TRADE))
add_bars("led_chain", f"{_CHAIN} SELECT {_TRADE_SQL} FROM ch", lambda b: shown(L.chain(barrier_ledger(b)), *_TRADE))
add_bars(
    "agg_fold_summary",
    f"""{_CHAIN}, fo AS (SELECT symbol, year(bar_ts) * 100 + month(bar_ts) AS ym, sum(pnl) AS p FROM ch JOIN bars ON bars.symbol = ch.symbol AND bars.seq = ch.exit_seq GROUP BY ALL)
 SELECT symbol, count(*) AS folds, {r('avg(p)', 'mean')}, {r('stddev_pop(p)', 'std')}, {r('min(p)', 'least')}, {r('max(p)', 'most')}, {r('exp(sum(ln(greatest(1 + p, 1e-12)))) - 1', 'cumulative')} FROM fo GROUP BY 1""".replace("SELECT symbol, year", "SELECT ch.symbol, year"),
    lambda b: shown(
        L.chain(barrier_ledger(b)).withColumnRenamed("exit_seq", "seq").join(b.select("symbol", "seq", "bar_ts"), ["symbol", "seq"]).groupBy("symbol", F.date_format("bar_ts", "yyyyMM").alias("ym")).agg(F.sum("pnl").alias("p")).groupBy("symbol")
        .agg(F.count("*").alias("folds"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("least"), F.max("p").alias("most"), (F.exp(F.sum(F.log(F.greatest(1 + F.col("p"), F.lit(1e-12))))) - 1).alias("cumulative")),
        "symbol", "folds", "mean", "std", "least", "most", "cumulative",
    ),
)
add_bars("win_vw_momentum", f"{RETS} SELECT symbol, seq, {r('ret * volume', 'vw_momentum')} FROM b", lambda b: shown(W.returns(b).withColumn("vw_momentum", F.col("ret") * F.col("volume")), "symbol", "seq", "vw_momentum"))
_DET = 1 - R.alpha_of(halflife=100)
add_bars("detrend", f"{WITH}, m AS (SELECT symbol, seq, ln(close) AS y, pow({_DET!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN ln(close) ELSE {1 - _DET!r} * ln(close) * pow({_DET!r}, 1 - seq) END) {over()} AS m FROM bars) SELECT symbol, seq, {r('y - m', 'detrended')} FROM m", lambda b: shown(R.linear_scan(b, (1 - _DET) * F.log("close"), _DET, "_m", F.log("close")).withColumn("detrended", F.log("close") - F.col("_m")), "symbol", "seq", "detrended"))

add_bars(
    "led_early_stop",
    f"""{_LED}, gr AS (SELECT *, exp(sum(ln(greatest(1 + gross_pnl, 1e-12))) OVER (PARTITION BY symbol ORDER BY trade_no)) AS growth FROM led2), m AS (SELECT *, min(growth) OVER (PARTITION BY symbol ORDER BY trade_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM gr)
 SELECT symbol, trade_no, {r('growth', 'growth')} FROM m WHERE coalesce(low, 1.0) >= 0.5""",
    lambda b: shown(L.until_ruin(L.spell_trades(signalled(b), "sig"), "gross_pnl"), "symbol", F.col("trade_no").cast("long").alias("trade_no"), "growth"),
)
add_bars(
    "join_folds_anchored",
    f"""{_FOLDS} SELECT f.symbol, CAST(fold AS INTEGER) AS fold, count(*) FILTER (CAST(bar_ts AS DATE) < a + CAST(fold * 5 + 10 AS INTEGER)) AS n_train, count(*) FILTER (CAST(bar_ts AS DATE) >= a + CAST(fold * 5 + 10 AS INTEGER)) AS n_test FROM f JOIN bars b ON b.symbol = f.symbol
 AND CAST(bar_ts AS DATE) < a + CAST(fold * 5 + 15 AS INTEGER) GROUP BY 1, 2""",
    # a day's bars are counted first, so what meets all folds is a row for each day
    lambda b: (lambda days: days.join(L.rolling_folds(days, 10, 5, 5, anchored=True), "symbol").where("day >= train_start AND day < test_end").groupBy("symbol", "fold").agg(F.sum(F.expr("if(day < train_end, n, 0)")).alias("n_train"), F.sum(F.expr("if(day >= test_start, n, 0)")).alias("n_test")))(b.groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.count("*").alias("n"))),
)
add_bars(
    "agg_calmar",
    f"""{_EQ}, k AS (SELECT q.symbol, q.seq, bar_ts, log_growth, (max(log_growth) OVER (PARTITION BY q.symbol ORDER BY q.seq)) - log_growth AS fall FROM q JOIN bars b ON b.symbol = q.symbol AND b.seq = q.seq),
 t AS (SELECT symbol, exp(arg_max(log_growth, seq)) - 1 AS ret, 1 - exp(-max(fall)) AS mdd, arg_max(log_growth, seq) * 365.25 / (epoch(max(bar_ts) - min(bar_ts)) / 86400) AS g FROM k GROUP BY 1) SELECT symbol, {r('ret', 'total_return')}, {r('mdd', 'mdd')}, {r('ret / nullif(mdd, 0)', 'calmar')}, {r('exp(g) - 1', 'cagr')} FROM t""",
    lambda b: (
        lambda k: shown(
            k.groupBy("symbol").agg((F.exp(F.max_by("log_growth", "seq")) - 1).alias("total_return"), (1 - F.exp(-F.max("fall"))).alias("mdd"), (F.max_by("log_growth", "seq") * 365.25 / F.try_divide(F.unix_seconds(F.max("bar_ts")) - F.unix_seconds(F.min("bar_ts")), F.lit(86400))).alias("g"))
            .withColumns({"calmar": F.try_divide("total_return", "mdd"), "cagr": F.exp("g") - 1}), "symbol", "total_return", "mdd", "calmar", "cagr",
        )
    )(equity(b).withColumn("fall", F.max("log_growth").over(W.so_far()) - F.col("log_growth"))),
)
add_bars(
    "win_vol_scale_global",
    f"{RETS}, s AS (SELECT symbol, seq, close, coalesce(stddev_samp(ret) {over(24)}, 0.0) AS rv, CASE WHEN close > avg(close) {over(20)} THEN 1 ELSE -1 END AS sig FROM b), q AS (SELECT symbol, quantile_cont(rv, 0.9) AS q FROM s GROUP BY 1) SELECT s.symbol, seq, CASE WHEN rv > q THEN 0 ELSE sig END AS sig FROM s JOIN q ON q.symbol = s.symbol",
    lambda b: (lambda s: s.join(s.groupBy("symbol").agg(F.percentile("realized_vol", F.lit(0.9)).alias("q")), "symbol").select("symbol", "seq", F.when(F.col("realized_vol") > F.col("q"), 0).otherwise(F.col("sig")).alias("sig")))(signalled(W.volatility(b))),
)
register(
    "agg_classif_scores",
    f"""WITH j AS (SELECT quality AS y, CAST(label % 2 AS INTEGER) AS p FROM labels JOIN embeddings ON doc_id = vec_id), c AS (SELECT DISTINCT y AS k FROM j UNION SELECT DISTINCT p FROM j),
 x AS (SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (p = k) AS predicted, count(*) FILTER (y = k) AS actual FROM j, c GROUP BY 1) SELECT k AS label, tp, predicted, actual, {r('tp * 1.0 / nullif(predicted, 0)', 'precision')}, {r('tp * 1.0 / nullif(actual, 0)', 'recall')}, {r('2.0 * tp / nullif(predicted + actual, 0)', 'f1')}, {r('sum(tp) OVER () * 1.0 / sum(actual) OVER ()', 'accuracy')} FROM x""",
)(
    # counted by pair of labels first: what follows has a row for each class
    lambda spark, d: (
        lambda cells: (lambda x: shown(
            x.withColumns({"precision": F.try_divide("tp", "predicted"), "recall": F.try_divide("tp", "actual"), "f1": F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("actual")), "accuracy": F.try_divide(F.sum("tp").over(Window.partitionBy(F.lit(1))), F.sum("actual").over(Window.partitionBy(F.lit(1))))}),
            "label", "tp", "predicted", "actual", "precision", "recall", "f1", "accuracy",
        ))(
            cells.select(F.explode(F.array(F.struct(F.col("y").cast("int").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("actual")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("actual")))).alias("s"))
            .groupBy("s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "predicted", "actual")])
        )
    )(QUERIES["agg_classif"](spark, d))
)
# exponential z-scores of features, by the closed form of the recurrence
def _ewm_sql(head: str, halflife: float, name: str) -> str:
    a = R.alpha_of(halflife=halflife)
    b = 1 - a
    return f"""{head}, m AS (SELECT symbol, seq, x, pow({b!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN x ELSE {a!r} * x * pow({b!r}, 1 - seq) END) {over()} AS m FROM x0),
 d AS (SELECT *, {b!r} * {a!r} * (x - lag(m) {BY}) * (x - lag(m) {BY}) AS d2 FROM m), v AS (SELECT *, pow({b!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN 0.0 ELSE d2 * pow({b!r}, 1 - seq) END) {over()} AS v FROM d),
 z AS (SELECT *, CASE WHEN seq = 1 OR sqrt(greatest(v, 0.0)) < 1e-10 THEN 0.0 ELSE (x - m) / sqrt(v) END AS z FROM v) SELECT symbol, seq, {r('5 * tanh(z / 5)', name)} FROM z"""


_GKV = f"sqrt(greatest(0.0, avg({_GK}) {over(24)}))"
add_bars("vol_z", _ewm_sql(f"{RETS}, x0 AS (SELECT symbol, seq, {_GKV} AS x FROM b)", 50, "vol_z"), lambda b: shown(R.ewm_z(W.volatility(b), "gk_vol", "vol_z", halflife=50), "symbol", "seq", "vol_z"))
for _h in (10, 50, 250, 1000):
    add_bars(f"momentum_z_{_h}", _ewm_sql(f"{RETS}, x0 AS (SELECT symbol, seq, ret * volume AS x FROM b)", _h, "momentum_z"), lambda b, h=_h: shown(R.ewm_z(W.returns(b).withColumn("vw_momentum", F.col("ret") * F.col("volume")), "vw_momentum", "momentum_z", halflife=h), "symbol", "seq", "momentum_z"))

# ---- aggregates -------------------------------------------------------------------------------

_DAY = f"{WITH}, d AS (SELECT symbol, CAST(bar_ts AS DATE) AS day, arg_min(open, seq) AS open, max(high) AS high, min(low) AS low, arg_max(close, seq) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2)"


def daily(b: DataFrame) -> DataFrame:
    return b.groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.min_by("open", "seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "seq").alias("close"), F.sum("volume").alias("volume"))


add_bars("agg_daily_ohlcv", f"{_DAY} SELECT symbol, day, {', '.join(r(x, x) for x in ('open', 'high', 'low', 'close', 'volume'))} FROM d", lambda b: shown(daily(b), "symbol", "day", "open", "high", "low", "close", "volume"))
add_bars("agg_corr_matrix", f"{_DAY}, x AS (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS x FROM d) SELECT a.symbol AS a, b.symbol AS b, {r('corr(a.x, b.x)', 'corr')} FROM x a JOIN x b ON a.day = b.day AND a.symbol < b.symbol GROUP BY 1, 2", lambda b: (lambda x: shown(x.alias("l").join(x.alias("r"), F.expr("l.day = r.day AND l.symbol < r.symbol")).groupBy(F.col("l.symbol").alias("a"), F.col("r.symbol").alias("b")).agg(F.corr("l.x", "r.x").alias("corr")), "a", "b", "corr"))(daily(b).withColumn("x", F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("day")) - 1)))
add_bars("agg_percentiles", f"{RETS} SELECT symbol, {', '.join(r(f'quantile_cont(ret, {q})', f'p{int(q * 100)}') for q in (0.01, 0.05, 0.5, 0.95, 0.99))} FROM b GROUP BY 1", lambda b: shown(W.returns(b).groupBy("symbol").agg(*[F.percentile("ret", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.01, 0.05, 0.5, 0.95, 0.99)]), "symbol", "p1", "p5", "p50", "p95", "p99"))
add_bars("agg_autocorr", f"{RETS}, g AS (SELECT symbol, ret, {', '.join(f'lag(ret, {k}) {BY} AS l{k}' for k in (1, 5, 10, 20))} FROM b) SELECT symbol, {', '.join(r(f'corr(ret, l{k})', f'ac{k}') for k in (1, 5, 10, 20))} FROM g GROUP BY 1", lambda b: shown(W.returns(b).withColumns({f"l{k}": F.lag("ret", k).over(W.by_seq()) for k in (1, 5, 10, 20)}).groupBy("symbol").agg(*[F.corr("ret", f"l{k}").alias(f"ac{k}") for k in (1, 5, 10, 20)]), "symbol", "ac1", "ac5", "ac10", "ac20"))
add_bars("agg_variance_ratio", f"{RETS}, h AS (SELECT symbol, ret, ntile(2) OVER (PARTITION BY symbol ORDER BY seq) AS half FROM b), v AS (SELECT symbol, var_samp(ret) FILTER (half = 1) / var_samp(ret) FILTER (half = 2) AS q, count(*) AS n FROM h GROUP BY 1) SELECT symbol, {r('q', 'ratio')}, q > 0.5 AND q < 2 AND n >= 20 AS stable FROM v", lambda b: shown(W.returns(b).withColumn("half", F.ntile(2).over(W.by_seq())).groupBy("symbol").agg((F.var_samp(F.when(F.col("half") == 1, F.col("ret"))) / F.var_samp(F.when(F.col("half") == 2, F.col("ret")))).alias("ratio"), F.count("*").alias("n")).withColumn("stable", (F.col("ratio") > 0.5) & (F.col("ratio") < 2) & (F.col("n") >= 20)), "symbol", "ratio", "stable"))
add_bars("agg_continuation", f"{WITH}, s AS (SELECT symbol, seq, close, CASE WHEN count(close) {over(42)} >= 42 THEN (close - avg(close) {over(42)}) / (stddev_samp(close) {over(42)} + 1e-10) END AS z, lead(close, 10) {BY} / close - 1 AS f FROM bars) SELECT symbol, count(*) AS n, {r('avg(CASE WHEN sign(z) * f > 0.005 THEN 1.0 ELSE 0.0 END)', 'share')} FROM s WHERE abs(z) >= 1 AND f IS NOT NULL GROUP BY 1", lambda b: shown(W.zscore(b, "close", 42).withColumn("f", L.future_return(b, 10)).where((F.abs("z") >= 1) & F.col("f").isNotNull()).groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.signum("z") * F.col("f") > 0.005).cast("double")).alias("share")), "symbol", "n", "share"))
add_bars("agg_validation", f"{WITH} SELECT 'volume' AS name, count(*) AS n, count(*) FILTER (volume IS NULL) AS nulls, count(*) FILTER (isinf(volume)) AS infs FROM bars UNION ALL SELECT 'close', count(*), count(*) FILTER (close IS NULL), count(*) FILTER (isinf(close)) FROM bars", lambda b: b.select(F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.col(x).alias("x")) for x in ("volume", "close")])).alias("s")).groupBy("s.name").agg(F.count("*").alias("n"), F.count_if(F.col("s.x").isNull()).alias("nulls"), F.count_if(F.abs("s.x") == float("inf")).alias("infs")))
add_bars(
    "agg_rank_ic",
    f"""{_TBM}, f AS (SELECT l.symbol, l.seq, label, ln(1 + volume) AS f1, (high - low) / close AS f2 FROM l JOIN bars b ON b.symbol = l.symbol AND b.seq = l.seq),
 u AS (SELECT symbol, label, 'f1' AS feature, f1 AS x FROM f UNION ALL SELECT symbol, label, 'f2', f2 FROM f), k AS (SELECT symbol, feature, rank() OVER (PARTITION BY symbol, feature ORDER BY x) + (count(*) OVER (PARTITION BY symbol, feature, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol, feature ORDER BY label) + (count(*) OVER (PARTITION BY symbol, feature, label) - 1) / 2.0 AS b FROM u),
 i AS (SELECT symbol, feature, abs(corr(a, b)) AS ic FROM k GROUP BY 1, 2) SELECT symbol, {r('avg(ic)', 'rank_ic')} FROM i GROUP BY 1""",
    lambda b: (
        lambda u: shown(
            u.withColumns({c: F.rank().over(Window.partitionBy("symbol", "feature").orderBy(x)) + (F.count("*").over(Window.partitionBy("symbol", "feature", x)) - 1) / 2 for c, x in (("ra", "x"), ("rb", "label"))}).groupBy("symbol", "feature").agg(F.abs(F.corr("ra", "rb")).alias("ic")).groupBy("symbol").agg(F.avg("ic").alias("rank_ic")), "symbol", "rank_ic"
        )
    )(tbm(b).join(b, ["symbol", "seq"]).select("symbol", "label", F.explode(F.array(F.struct(F.lit("f1").alias("feature"), F.log1p("volume").alias("x")), F.struct(F.lit("f2").alias("feature"), ((F.col("high") - F.col("low")) / F.col("close")).alias("x")))).alias("s")).select("symbol", "label", "s.feature", "s.x")),
)
register("agg_classif", "WITH j AS (SELECT quality AS y, CAST(label % 2 AS INTEGER) AS p FROM labels JOIN embeddings ON doc_id = vec_id) SELECT y, p, count(*) AS n FROM j GROUP BY 1, 2")(
    lambda spark, d: M.table(spark, d, "labels").join(M.table(spark, d, "embeddings"), F.expr("doc_id = vec_id")).groupBy(F.col("quality").alias("y"), (F.col("label") % 2).cast("int").alias("p")).agg(F.count("*").alias("n"))
)
register("set_dedup", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")(lambda spark, d: M.table(spark, d, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("k = 1").select("o_custkey", "o_orderkey"))
register("agg_period", f"WITH d AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT symbol, year(day) AS year, {r('arg_min(v, day)', 'first')}, {r('arg_max(v, day)', 'last')}, {r('arg_max(v, day) / arg_min(v, day) - 1', 'ret')}, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) >= 10")(
    lambda spark, d: shown(M.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v")).groupBy("symbol", F.year("day").cast("long").alias("year")).agg(F.min_by("v", "day").alias("first"), F.max_by("v", "day").alias("last"), (F.max_by("v", "day") / F.min_by("v", "day") - 1).alias("ret"), F.count("*").alias("n")).where("n >= 10"), "symbol", "year", "first", "last", "ret", "n")
)

# ---- streaming --------------------------------------------------------------------------------

register("st_tumbling_day", f"WITH {_DAILY} SELECT symbol, day, {r('day_quote', 'day_quote')} FROM daily")(
    # complete: each trigger gives all days; the last batch is the whole
    lambda spark, d: shown(S.drained(S.daily_volume(S.read_events(spark, f"{d}/events.parquet")), "complete").groupBy("symbol", "day").agg(F.max("day_quote").alias("day_quote")), "symbol", "day", "day_quote")
)
register("st_dedup", f"WITH {M.TRADES_SQL} SELECT symbol, count(*) AS n FROM trades GROUP BY 1")(lambda spark, d: S.drained(S.deduplicated(S.read_events(spark, f"{d}/events.parquet"))).groupBy("symbol").agg(F.count("*").alias("n")))

# ---- regimes, spells, samples -----------------------------------------------------------------

_N20 = over(start="1 FOLLOWING", end="20 FOLLOWING")
_M20 = over(start="2 FOLLOWING", end="20 FOLLOWING")
add_bars(
    "win_future_moves",
    f"""{RETS}, s AS (SELECT *, {_TR} AS tr, stddev_samp(ret) {over(24)} AS vol, stddev_samp(ret) {_M20} AS fv, max(high) {_N20} - min(low) {_N20} AS sp FROM b), a AS (SELECT *, CASE WHEN count(tr) {over(14)} >= 14 THEN avg(tr) {over(14)} END AS atr FROM s)
 SELECT symbol, seq, CAST(sp >= sqrt(20.0) * atr AS INTEGER) AS wide_range, CAST(fv >= vol AS INTEGER) AS high_vol FROM a""",
    lambda b: W.future_moves(b).select("symbol", "seq", "wide_range", "high_vol"),
)
_DD = f"(max(close) {over()} - close) / max(close) {over()}"
_SP = f"{WITH}, f AS (SELECT symbol, seq, close, CAST(close > open AS INTEGER) AS f FROM bars), c AS (SELECT *, CASE WHEN f = lag(f) {BY} THEN 0 ELSE 1 END AS ch FROM f), s AS (SELECT *, sum(ch) {over()} AS s FROM c)"
add_bars("agg_spells", f"{_SP} SELECT symbol, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS bars, {r('arg_max(close, seq) / arg_min(close, seq) - 1', 'ret')} FROM s WHERE f = 1 GROUP BY symbol, s", lambda b: shown(G.spells(b, F.col("close") > F.col("open")), "symbol", "first_seq", "last_seq", "bars", "ret"))
add_bars("win_streaks", f"{_SP}, n AS (SELECT symbol, s, f, count(*) AS n FROM s GROUP BY 1, 2, 3) SELECT symbol, coalesce(max(n) FILTER (f = 1), 0) AS longest_win, coalesce(max(n) FILTER (f = 0), 0) AS longest_loss FROM n GROUP BY 1", lambda b: G.streaks(b, F.col("close") > F.col("open")))
add_bars("hmm_transition", f"{_SP}, t AS (SELECT symbol, f AS to_state, lag(f) {BY} AS from_state FROM s) SELECT symbol, from_state, to_state, count(*) AS n, {r('count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY symbol, from_state)', 'p')} FROM t WHERE from_state IS NOT NULL GROUP BY 1, 2, 3", lambda b: shown(G.transitions(b.withColumn("f", (F.col("close") > F.col("open")).cast("int")), "f"), "symbol", "from_state", "to_state", "n", "p"))
add_bars(
    "agg_mi",
    f"""{_TBM}, x AS (SELECT l.symbol, label, ntile(8) OVER (PARTITION BY l.symbol ORDER BY volume, l.seq) AS bin FROM l JOIN bars b ON b.symbol = l.symbol AND b.seq = l.seq), n AS (SELECT symbol, bin, label, count(*) AS n FROM x GROUP BY 1, 2, 3),
 t AS (SELECT *, sum(n) OVER (PARTITION BY symbol) AS t, sum(n) OVER (PARTITION BY symbol, bin) AS nb, sum(n) OVER (PARTITION BY symbol, label) AS ny FROM n) SELECT symbol, {r('sum(n * 1.0 / t * ln(n * 1.0 * t / (nb * ny)))', 'mi')} FROM t GROUP BY 1""",
    lambda b: shown(G.mutual_information(tbm(b).join(b, ["symbol", "seq"]), "volume", "label"), "symbol", "mi"),
)
add_bars(
    "join_benchmark",
    f"{_EQ}, d AS (SELECT q.symbol, CAST(b.bar_ts AS DATE) AS day, sum(pnl) AS strategy, arg_max(q.close, q.seq) / arg_min(q.close, q.seq) - 1 AS hold FROM q JOIN bars b ON b.symbol = q.symbol AND b.seq = q.seq GROUP BY 1, 2) SELECT symbol, day, {r('strategy', 'strategy')}, {r('hold', 'hold')}, {r('strategy - hold', 'alpha')} FROM d",
    lambda b: shown(equity(b).groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.sum("bar_pnl").alias("strategy"), (F.max_by("close", "seq") / F.min_by("close", "seq") - 1).alias("hold")).withColumn("alpha", F.col("strategy") - F.col("hold")), "symbol", "day", "strategy", "hold", "alpha"),
)
add_bars(
    "eq_portfolio",
    f"{_EQ} SELECT b.bar_ts, count(*) AS n, {r('avg(pnl)', 'pnl')} FROM q JOIN bars b ON b.symbol = q.symbol AND b.seq = q.seq GROUP BY 1",
    lambda b: shown(equity(b).groupBy("bar_ts").agg(F.count("*").alias("n"), F.avg("bar_pnl").alias("pnl")), F.col("bar_ts").cast("timestamp_ntz").alias("bar_ts"), "n", "pnl"),
)
add_bars(
    "agg_threshold_sweep",
    f"{RETS}, s AS (SELECT symbol, lead(ret) {BY} AS f, percent_rank() OVER (PARTITION BY symbol ORDER BY volume, seq) AS p FROM b), t AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS th) SELECT symbol, CAST(th AS DOUBLE) AS threshold, count(f) AS n, {r('sum(f)', 'total')} FROM s, t WHERE p >= th GROUP BY 1, 2",
    lambda b: shown(W.returns(b).withColumns({"f": F.lead("ret").over(W.by_seq()), "p": F.percent_rank().over(Window.partitionBy("symbol").orderBy("volume", "seq"))}).withColumn("threshold", F.explode(F.array(*[F.lit(k / 20) for k in range(10, 20)]))).where("p >= threshold").groupBy("symbol", "threshold").agg(F.count("f").alias("n"), F.sum("f").alias("total")), "symbol", "threshold", "n", "total"),
)
add_bars("topk_results", f"{_LED} SELECT * FROM (SELECT symbol, trade_no, {r('gross_pnl', 'gross_pnl')}, row_number() OVER (PARTITION BY symbol ORDER BY gross_pnl DESC, trade_no) AS k FROM led2) WHERE k <= 5", lambda b: shown(L.spell_trades(signalled(b), "sig").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("gross_pnl"), "trade_no"))).where("k <= 5"), "symbol", F.col("trade_no").cast("long").alias("trade_no"), "gross_pnl", F.col("k").cast("long").alias("k")))
register("set_intersect_dates", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")(lambda spark, d: M.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).intersect(M.table(spark, d, "lineitem").select(F.to_date("l_shipdate"))))
register("set_union_dates", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem")(lambda spark, d: M.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).union(M.table(spark, d, "lineitem").select(F.to_date("l_shipdate"))).distinct())
add_bars("balanced_sample", None, lambda b: G.balanced_sample(tbm(b), "label", 500).groupBy("label").agg(F.count("*").alias("n")))

# ---- sizes, stops and signals -----------------------------------------------------------------


def size_levels(b: DataFrame) -> DataFrame:
    b = ruled(b).withColumn("sig", F.sign(F.col("close") - F.col("tr")).cast("int"))
    close, sig, u = F.col("close"), F.col("sig"), F.col("u")
    sd = F.sqrt(u) / F.greatest("tr", F.lit(1e-10))
    return shown(b.withColumns({"factor": Z.size_uncertainty(u), "leverage": Z.size_vol_target(close, F.sqrt(u)), "stop": Z.stop_price(close, sig, F.sqrt(u)), "log_stop": Z.log_level(close, sig, sd, -2.0), "add_at": Z.log_level(close, sig, sd, 1.0)}), "symbol", "seq", "sig", "factor", "leverage", "stop", "log_stop", "add_at")


add_bars(
    "size_levels",
    f"""{_RULED}, g AS (SELECT *, CAST(sign(close - tr) AS INTEGER) AS sig, sqrt(u) / greatest(tr, 1e-10) AS sd FROM v)
 SELECT symbol, seq, sig, {r('CASE WHEN u <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - (ln(least(greatest(u, 0.1), 100.0)) - ln(0.1)) / (ln(100.0) - ln(0.1) + 1e-10))) END', 'factor')}, {r('least(3.0, greatest(0.0, 0.02 * close / (2 * sqrt(u) * close + 1e-10)))', 'leverage')},
 {r('CASE WHEN sig <> 0 THEN close - sig * 2 * sqrt(u) END', 'stop')}, {r('CASE WHEN sig <> 0 THEN close * exp(-2 * sig * sd) END', 'log_stop')}, {r('CASE WHEN sig <> 0 THEN close * exp(sig * sd) END', 'add_at')} FROM g""",
    size_levels,
)


def size_regime_vol(b: DataFrame) -> DataFrame:
    b = ruled(b).withColumn("rv", F.stddev_samp("ret").over(W.last_rows(24)))
    pace, mean = F.abs("v"), W.full(F.col("rv"), W.last_rows(100), 100, F.avg("rv").over(W.last_rows(100)))
    multiple = F.when(pace > 0.5 * F.sqrt("u"), 1.2).when(pace < 0.1 * F.sqrt("u"), 0.8).otherwise(0.5)
    return shown(b.withColumn("size", Z.size_regime_vol(multiple, F.try_divide("rv", mean))), "symbol", "seq", "size")


add_bars(
    "size_regime_vol",
    f"""{_RULED}, q AS (SELECT *, {RET} AS ret FROM v), w AS (SELECT *, stddev_samp(ret) {over(24)} AS rv FROM q), z AS (SELECT *, CASE WHEN count(rv) {over(100)} >= 100 THEN rv / nullif(avg(rv) {over(100)}, 0) END AS ratio FROM w)
 SELECT symbol, seq, {r('coalesce(CASE WHEN abs(v) > 0.5 * sqrt(u) THEN 1.2 WHEN abs(v) < 0.1 * sqrt(u) THEN 0.8 ELSE 0.5 END / CASE WHEN ratio IS NOT NULL THEN least(greatest(ratio, 0.5), 2.0) END, 1.0)', 'size')} FROM z""",
    size_regime_vol,
)
_THIRD = 1 - 1 / 3
add_bars(
    "connors",
    f"""{WITH}, a AS (SELECT symbol, seq - 1 AS seq, CASE WHEN lag(close) {BY} > 1e-10 THEN close / lag(close) {BY} - 1 ELSE 0.0 END AS ret FROM bars), g AS (SELECT *, greatest(ret, 0.0) AS g, greatest(-ret, 0.0) AS l FROM a WHERE seq >= 1),
 s AS (SELECT symbol, seq, ret, pow({_THIRD!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN g ELSE g / 3 * pow({_THIRD!r}, 1 - seq) END) {over()} AS up, pow({_THIRD!r}, seq - 1) * sum(CASE WHEN seq = 1 THEN l ELSE l / 3 * pow({_THIRD!r}, 1 - seq) END) {over()} AS dn, list(ret) {over(100)} AS v FROM g),
 z AS (SELECT symbol, seq + 1 AS seq, (CASE WHEN up < 1e-10 AND dn < 1e-10 THEN 50.0 WHEN dn < 1e-10 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END + CASE WHEN len(v) < 2 THEN 50.0 ELSE 100.0 * len(list_filter(v, lambda x: x < ret)) / (len(v) - 1) END) / 2 AS c FROM s)
 SELECT symbol, seq, {r('c', 'connors')} FROM z UNION ALL SELECT symbol, seq, 0.0 FROM bars WHERE seq = 1""",
    lambda b: shown(I.connors(b), "symbol", "seq", "connors"),
)
add_bars(
    "win_resid_std",
    f"""{_RULED}, e AS (SELECT symbol, seq, CASE WHEN close > 0 AND tr > 0 THEN ln(CASE WHEN close > 0 THEN close END) - ln(CASE WHEN tr > 0 THEN tr END) END AS resid FROM v), w AS (SELECT *, stddev_pop(resid) OVER (PARTITION BY symbol) AS whole, CASE WHEN count(resid) {over(180)} >= 30 THEN stddev_samp(resid) {over(180)} END AS sd FROM e)
 SELECT symbol, seq, {r('resid', 'resid')}, {r('coalesce(sd, CASE WHEN whole >= 1e-10 THEN whole END, 0.01)', 'resid_sd')} FROM w""",
    lambda b: shown(I.residual_sd(ruled(b), "tr"), "symbol", "seq", "resid", "resid_sd"),
)
add_bars(
    "win_stress",
    f"""{_RULED}, e AS (SELECT symbol, seq, (close - lag(tp) {BY}) / nullif(sqrt(lag(u) {BY}), 0) AS e FROM v)
 SELECT symbol, seq, {r(f'CASE WHEN count(e) {over(20)} >= 5 THEN avg(e * e) {over(20)} END', 'stress')} FROM e""",
    lambda b: shown(I.stress(ruled(b), "tp", "u"), "symbol", "seq", "stress"),
)
add_bars(
    "agg_reversal_accuracy",
    f"""{WITH}, s AS (SELECT symbol, seq, CASE WHEN count(close) {over(42)} >= 42 THEN (close - avg(close) {over(42)}) / (stddev_samp(close) {over(42)} + 1e-10) END AS z, lead(close, 10) {BY} / close - 1 AS f FROM bars), p AS (SELECT *, lag(z) {BY} AS pz FROM s),
 q AS (SELECT symbol, abs(z - pz) AS jump, sign(z) * f AS won FROM p WHERE sign(z) <> sign(pz) AND f IS NOT NULL)
 SELECT symbol, CASE WHEN jump < 1 THEN 'weak' WHEN jump < 2 THEN 'medium' ELSE 'strong' END AS intensity, count(*) AS n, {r('avg(CASE WHEN won > 0 THEN 1.0 ELSE 0.0 END)', 'accuracy')}, {r('avg(CASE WHEN won < -0.01 THEN 1.0 ELSE 0.0 END)', 'fake_outs')} FROM q GROUP BY 1, 2""",
    lambda b: shown(I.reversals(W.zscore(b, "close", 42).withColumn("f", L.future_return(b, 10)), "z", F.col("f")), "symbol", "intensity", "n", "accuracy", "fake_outs"),
)
add_bars(
    "rule_momentum",
    f"{_RULED}, ac AS (SELECT symbol, seq, v / nullif(sqrt(u), 0) AS s, v - lag(v) {BY} AS d FROM v) SELECT symbol, seq, CASE WHEN s > 0.3 AND d > 0 THEN 1 WHEN s < -0.3 AND d < 0 THEN -1 ELSE 0 END AS signal FROM ac",
    lambda b: ruled(b).select("symbol", "seq", I.momentum_signal(F.try_divide(F.col("v"), F.sqrt("u")), F.col("v") - F.lag("v").over(W.by_seq())).alias("signal")),
)
add_bars(
    "clean_features",
    f"""{WITH}, s AS (SELECT symbol, seq, close, open, CASE WHEN count(close) {over(42)} >= 42 THEN (close - avg(close) {over(42)}) / (stddev_samp(close) {over(42)} + 1e-10) END AS z FROM bars)
 SELECT symbol, CAST(sign(close - open) + 1 AS INTEGER) AS class, count(*) AS n, {r('avg(z)', 'mean_z')} FROM s WHERE z IS NOT NULL GROUP BY 1, 2""",
    lambda b: shown(N.drop_incomplete(W.zscore(b, "close", 42), ["z"]).groupBy("symbol", N.remap_labels(F.sign(F.col("close") - F.col("open"))).alias("class")).agg(F.count("*").alias("n"), F.avg(N.nan_to_num("z")).alias("mean_z")), "symbol", "class", "n", "mean_z"),
)


def set_common_columns(b: DataFrame) -> DataFrame:
    frames = b, daily(b)
    names = N.common_columns(*frames)
    return shown(frames[0].select(*names).unionByName(frames[1].select(*names)).groupBy("symbol").agg(F.count("*").alias("n"), F.max("high").alias("high"), F.avg("close").alias("close")), "symbol", "n", "high", "close")


add_bars("set_common_columns", f"{_DAY}, x AS (SELECT symbol, high, close FROM bars UNION ALL SELECT symbol, high, close FROM d) SELECT symbol, count(*) AS n, {r('max(high)', 'high')}, {r('avg(close)', 'close')} FROM x GROUP BY 1", set_common_columns)
register("topk_params", f"SELECT symbol, threshold, total FROM ({ORACLE_SQL['agg_threshold_sweep']}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY total DESC, threshold) = 1")(
    # equal totals go to the first in the grid's order
    lambda spark, d: QUERIES["agg_threshold_sweep"](spark, d).groupBy("symbol").agg(F.max_by(F.struct("threshold", "total"), F.struct("total", -F.col("threshold"))).alias("best")).select("symbol", "best.threshold", "best.total")
)

from . import models  # noqa: E402, F401  registers its queries, and needs what is above
