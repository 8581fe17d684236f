"""Market tables derived from the given event and order tables, and their readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("trade_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("qty", T.DoubleType()),
        T.StructField("quote_qty", T.DoubleType()),
        T.StructField("ts_ms", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
        T.StructField("is_best_match", T.BooleanType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_trades_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Trades from CSV with 6 columns (futures, is_best_match is then true) or 7 (spot). Header lines and rows whose id is no number are left out; white space is trimmed."""
    names = [f.name for f in TRADE_SCHEMA]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    typed = raw.select(*[F.expr(f"try_cast(trim({f.name}) AS {f.dataType.simpleString()})").alias(f.name) for f in TRADE_SCHEMA])
    return typed.where("trade_id IS NOT NULL").withColumn("is_best_match", F.coalesce("is_best_match", F.lit(True))).withColumn("symbol", F.lit(symbol))


def read_trades_zip(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Trades from zip archives of CSV members; other members are left out. An archive can't be split, so it is one task, which streams its lines; lines are then dealt out."""
    import io
    import zipfile

    import pyarrow as pa

    def lines(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if member.lower().endswith(".csv"):
                            with archive.open(member) as f:
                                text = io.TextIOWrapper(f, "utf-8")
                                while chunk := text.readlines(1 << 20):
                                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in chunk])], ["line"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "line string")
    typed = rows.repartition(spark.sparkContext.defaultParallelism).select(*[F.expr(f"try_cast(trim(get(split(line, ','), {i})) AS {f.dataType.simpleString()})").alias(f.name) for i, f in enumerate(TRADE_SCHEMA)])
    return typed.where("trade_id IS NOT NULL").withColumn("is_best_match", F.coalesce("is_best_match", F.lit(True))).withColumn("symbol", F.lit(symbol))


def invalid_reason():
    """Why a trade is malformed, null for a good one."""
    c = F.col
    return (
        F.when(c("price").isNull() | F.isnan("price") | (c("price") <= 0) | (c("price") == float("inf")), "price")
        .when(c("qty").isNull() | F.isnan("qty") | (c("qty") < 0), "qty")
        .when(c("quote_qty").isNull() | F.isnan("quote_qty") | (c("quote_qty") < 0), "quote_qty")
        .when(c("ts_ms").isNull() | (c("ts_ms") <= 0), "ts_ms")
        .when(c("trade_id").isNull() | (c("trade_id") <= 0), "trade_id")
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("reason", invalid_reason())
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-formed trades: bars, labels and ledgers never see a price of 0."""
    return split_valid(raw_trades(spark, sf_dir))[0]


def raw_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from events: the event type is the symbol, the value the price, props.k + 1 the quantity."""
    e = table(spark, sf_dir, "events")
    qty = (F.get_json_object("props", "$.k").cast("int") + 1).cast("double")
    out = e.select(
        F.col("event_type").alias("symbol"),
        (F.col("event_id") + 1).alias("trade_id"),
        F.col("value").alias("price"),
        qty.alias("qty"),
        (F.col("value") * qty).alias("quote_qty"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
    )
    return out.withColumn("is_aggressor_buy", ~F.col("is_buyer_maker"))


def sequenced(df: DataFrame, *order: str) -> DataFrame:
    """df with seq, the row's number within its symbol by a total order."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)).cast("long"))


def bars(spark: SparkSession, sf_dir: str, every: str = "hour") -> DataFrame:
    """Time bars of each symbol's trades."""
    return sequenced(bars_of(trades(spark, sf_dir), every), "bar_ts")


def bars_of(trades_: DataFrame, every: str = "hour") -> DataFrame:
    """Time bars of trades, without seq."""
    t = trades_.withColumn("bar_ts", F.date_trunc(every, "ts"))
    buy = F.when(F.col("is_aggressor_buy"), F.col("quote_qty")).otherwise(0.0)
    return t.groupBy("symbol", "bar_ts").agg(
        F.min_by("price", "trade_id").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "trade_id").alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("quote_qty").alias("dollar"),
        F.count("*").alias("ticks"),
        F.sum(buy).alias("buy"),
        F.greatest((F.max("ts_ms") - F.min("ts_ms")) / 1000.0, F.lit(0.001)).alias("duration"),
    )


def write_by_month(bars_: DataFrame, path: str, ts: str = "bar_ts") -> None:
    """Bars to the month in which they start; only months in bars_ are replaced."""
    bars_.withColumn("ym", F.date_format(ts, "yyyy-MM")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "ym").parquet(path)


def read_months(spark: SparkSession, path: str, first: str, last: str, symbol: str | None = None) -> DataFrame:
    """Bars of the months first..last ("yyyy-MM"), by partition pruning."""
    out = spark.read.parquet(path).where((F.col("ym") >= first) & (F.col("ym") <= last))
    return out if symbol is None else out.where(F.col("symbol") == symbol)


#: The same tables for DuckDB.
RAW_TRADES_SQL = """raw_trades AS (SELECT event_type AS symbol, event_id + 1 AS trade_id, value AS price, CAST(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS qty,
 value * (1 + CAST(json_extract_string(props, '$.k') AS INTEGER)) AS quote_qty, epoch_us(ts) // 1000 AS ts_ms, ts, user_id % 2 = 0 AS is_buyer_maker, user_id % 2 <> 0 AS is_aggressor_buy FROM events)"""
TRADES_SQL = RAW_TRADES_SQL + """,
trades AS (SELECT * FROM raw_trades WHERE price > 0 AND isfinite(price) AND qty >= 0 AND quote_qty >= 0 AND ts_ms > 0 AND trade_id > 0)"""
BARS_SQL = (
    TRADES_SQL
    + """,
bars0 AS (SELECT symbol, date_trunc('hour', ts) AS bar_ts, arg_min(price, trade_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, trade_id) AS close, sum(qty) AS volume, sum(quote_qty) AS dollar,
 count(*) AS ticks, sum(CASE WHEN is_aggressor_buy THEN quote_qty ELSE 0.0 END) AS buy, greatest((max(ts_ms) - min(ts_ms)) / 1000.0, 0.001) AS duration FROM trades GROUP BY ALL),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS seq FROM bars0)"""
)
