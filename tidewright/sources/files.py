"""Typed files: bars, features, signals, metrics and result tables, and the joins that bring them together again."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "int": T.IntegerType()}[t]) for n, t in (f.split() for f in text.split(", "))])


_DOUBLES = ", ".join(
    f"{c} double"
    for c in "open high low close log_volume log_tick_count log_duration log_trade_intensity vwap_deviation volume_imbalance bar_range bar_body garman_klass_vol realized_vol shannon_entropy vol_ratio vol_zscore entropy_zscore skewness kurtosis "
    "frac_diff_close detrended_log_price returns vw_momentum momentum_zscore_10 momentum_zscore_50 momentum_zscore_250 momentum_zscore_1000 connors_rsi sin_time cos_time sin_week cos_week".split()
)
FEATURES = _schema(f"start_time long, end_time long, {_DOUBLES}, is_primed boolean")
BARS = _schema("start_time long, end_time long, open double, high double, high_time long, low double, low_time long, close double, volume double, dollar_value double, tick_count long, buy_dollar_vol double, sell_dollar_vol double, net_imbalance double, duration double")
TIB_BARS = _schema("timestamp long, open double, high double, low double, close double, volume double, tick_count long")
#: The columns that a ledger reads of bars or features.
PRICES = _schema("timestamp long, open double, high double, high_time long, low double, low_time long, close double, volume double, realized_vol double")


class SchemaMismatch(ValueError):
    """Columns that are missing, or of another type than the file's kind has."""


def checked(df: DataFrame, schema: T.StructType, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """df's keys and the columns of schema, in its order; SchemaMismatch where one is missing or its type can't be widened to the schema's."""
    have = {f.name: f.dataType for f in df.schema}
    wide = {(T.IntegerType, T.LongType), (T.ShortType, T.LongType), (T.FloatType, T.DoubleType), (T.IntegerType, T.DoubleType), (T.LongType, T.DoubleType)}
    wrong = [f"{f.name} ({have[f.name].simpleString() if f.name in have else 'missing'}, not {f.dataType.simpleString()})" for f in schema if f.name not in have or (have[f.name] != f.dataType and (type(have[f.name]), type(f.dataType)) not in wide)]
    if wrong:
        raise SchemaMismatch(", ".join(wrong))
    return df.select(*[k for k in keys if k in have], *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_typed(df: DataFrame, path: str, schema: T.StructType, month_of: Column | None = None) -> None:
    """df as Parquet by symbol, and by month (ym) where month_of gives a time; only partitions that df has are replaced."""
    rows = checked(df, schema)
    by = ["symbol"]
    if month_of is not None:
        rows, by = rows.withColumn("ym", F.date_format(month_of, "yyyy-MM")), ["symbol", "ym"]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_typed(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Rows of typed files; with columns only those are read. The files' own schema is checked against the kind's."""
    found = checked(spark.read.parquet(path), schema)
    return found if columns is None else found.select("symbol", *columns)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns of PRICES, whatever else the files hold."""
    return read_typed(spark, path, PRICES)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """symbol, seq, signal (-1, 0 or 1), size and stop_price of files that may lack the last two, by symbol and seq.

    A column counts as given if any of its values is over 0: then a size that isn't over 0 is 1, else all sizes are 1; stop
    prices that aren't given are null. Other signals are refused.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    absent = lambda c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
    rows = rows.select("symbol", F.col("seq").cast("long").alias("seq"), F.col("signal").cast("int").alias("signal"), absent("size").alias("size"), absent("sl_price").alias("sl_price"))
    bad, sizes, stops = rows.agg(F.count_if(~F.coalesce(F.col("signal").isin(-1, 0, 1), F.lit(False))), F.count_if(F.col("size") > 0), F.count_if(F.col("sl_price") > 0)).first()
    if bad:
        raise SchemaMismatch(f"{bad} signals are none of -1, 0 and 1")
    size = F.when(F.col("size") > 0, F.col("size")).otherwise(1.0) if sizes else F.lit(1.0)
    return rows.select("symbol", "seq", "signal", size.alias("size"), (F.col("sl_price") if stops else F.lit(None).cast("double")).alias("stop_price")).orderBy("symbol", "seq")


def enabled_symbols(config: DataFrame, only: str | None = None) -> DataFrame:
    """symbol, market and priority of the enabled rows, by priority and name; of one symbol alone if it is named."""
    rows = config.where("enabled") if only is None else config.where(F.col("symbol") == only)
    return rows.select("symbol", "market", "priority").orderBy("priority", "symbol")


def dataset_path(root: str, kind: str, market: str, symbol: str, bars_per_day: int) -> str:
    """Where a symbol's files of a kind lie: folders that Spark reads as partition columns."""
    return f"{root.rstrip('/')}/{kind}/market={market}/bars_per_day={bars_per_day}/symbol={symbol}"


def config_hash(config: dict) -> str:
    """The first 8 digits of the md5 of a configuration, whatever the order of its keys."""
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:8]


def hashed_path(root: str, name: str, config: dict) -> str:
    return f"{root.rstrip('/')}/{name}-{config_hash(config)}"


def finite(df: DataFrame) -> DataFrame:
    """df with null in place of NaN and infinities, in numbers and in arrays of them."""
    ok = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        out.append((ok(F.col(f.name)) if kind in ("double", "float") else F.transform(f.name, ok) if kind in ("array<double>", "array<float>") else F.col(f.name)).alias(f.name))
    return df.select(*out)


def write_metrics(df: DataFrame, path: str) -> None:
    """A line of JSON for each row, all columns named, null for what JSON has no number for."""
    finite(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


# ---- joins ------------------------------------------------------------------------------------


def join_features(bars: DataFrame, features: DataFrame, primed: bool = True) -> DataFrame:
    """bars with the features of their start_time (the first of repeated ones), features' own copies of bars' columns dropped; only primed rows, if asked."""
    first = features.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "start_time").orderBy("end_time"))).where("_n = 1").drop("_n")
    out = bars.join(first.select("symbol", "start_time", *[c for c in first.columns if c not in bars.columns]), ["symbol", "start_time"])
    return out.where("is_primed") if primed and "is_primed" in out.columns else out


def join_signals(signals: DataFrame, bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with their signals, and what doesn't match: symbol, and the number of signals without a bar and of bars without a signal."""
    both = signals.withColumn("_s", F.lit(1)).join(bars.withColumn("_b", F.lit(1)), ["symbol", "seq"], "full_outer")
    missing = both.groupBy("symbol").agg(F.count_if(F.col("_b").isNull()).alias("no_bar"), F.count_if(F.col("_s").isNull()).alias("no_signal")).where("no_bar > 0 OR no_signal > 0")
    return both.where("_s IS NOT NULL AND _b IS NOT NULL").drop("_s", "_b"), missing


def event_windows(df: DataFrame, events: DataFrame, sizes: tuple[int, ...] = (120, 180, 252), before: tuple[int, ...] = (0, 10, 20, 30, 45), least: int = 60) -> DataFrame:
    """symbol, event, size, days_before, first_seq, last_seq and closes: the rows up to an event's last bar, `size` back from it, that end days_before bars earlier.

    events: symbol, event (a name), event_ts. Windows of fewer than `least` bars from first to last are left out. Events
    find their bar by the last one up to them; windows then meet bars on blocks of the longest size.
    """
    marks = df.select("symbol", F.col("bar_ts").alias("t"), "seq", F.lit(None).cast("string").alias("event")).unionByName(events.select("symbol", F.col("event_ts").alias("t"), F.lit(None).cast("long").alias("seq"), "event"))
    order = Window.partitionBy("symbol").orderBy("t", F.col("event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    at = marks.withColumn("at", F.last("seq", ignorenulls=True).over(order)).where("event IS NOT NULL AND at IS NOT NULL")
    block = max(sizes) + 1
    own = at.select("symbol", "event", "at", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")).withColumn("first_seq", F.greatest(F.lit(1), F.col("at") - F.col("size")).cast("long"))
    own = own.withColumn("days_before", F.explode(F.array(*[F.lit(n) for n in before]))).withColumn("last_seq", F.col("at") - F.col("days_before")).where(F.col("last_seq") - F.col("first_seq") >= least)
    blocks = own.withColumn("_block", F.explode(F.sequence(F.floor(F.col("first_seq") / block), F.floor(F.col("last_seq") / block))))
    met = blocks.join(df.select("symbol", F.col("seq").alias("_seq"), F.col("close").alias("_close"), F.floor(F.col("seq") / block).alias("_block")), ["symbol", "_block"]).where("_seq BETWEEN first_seq AND last_seq")
    grouped = met.groupBy("symbol", "event", "size", "days_before", "first_seq", "last_seq").agg(F.array_sort(F.collect_list(F.struct("_seq", "_close"))).alias("c"))
    return grouped.select("symbol", "event", "size", "days_before", "first_seq", "last_seq", F.col("c._close").alias("closes"))
