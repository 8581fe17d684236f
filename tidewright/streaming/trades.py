"""Structured Streaming forms: ingest, deduplication, daily volumes, stateful bars."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from .features import ROCKS, UNCHECKED, ascending, in_order

LATE = "45 days"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Trades from an event folder or file as a stream; new files are read as they come."""
    schema = spark.read.parquet(path).schema
    # as a pattern: a stream takes a plain path only if it is a folder
    path = path.rstrip("/")
    e = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    qty = (F.get_json_object("props", "$.k").cast("int") + 1).cast("double")
    return e.select(
        F.col("event_type").alias("symbol"),
        (F.col("event_id") + 1).alias("trade_id"),
        F.col("value").alias("price"),
        qty.alias("qty"),
        (F.col("value") * qty).alias("quote_qty"),
        F.col("ts").cast("timestamp").alias("ts"),
    ).where("price > 0 AND qty >= 0")


def deduplicated(trades: DataFrame) -> DataFrame:
    """Each trade id of a symbol once; what is older than LATE behind the newest time is late and left out."""
    return trades.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["symbol", "trade_id"])


def daily_volume(trades: DataFrame) -> DataFrame:
    return trades.withWatermark("ts", LATE).groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.sum("quote_qty").alias("day_quote"), F.count("*").alias("n")).select("symbol", F.to_date("w.start").alias("day"), "day_quote", "n")


BAR = "symbol string, bar_no long, start_time timestamp, end_time timestamp, open double, high double, low double, close double, volume double, dollar_value double, tick_count long"
STATE = "bar_no long, last_id long, start_time timestamp, end_time timestamp, open double, high double, low double, close double, volume double, dollar_value double, tick_count long"


def dollar_bars(trades: DataFrame, threshold: float) -> DataFrame:
    """Bars that close when their quote volume reaches the threshold. The state of a symbol is its open bar and the last trade id; trades up to that id are repeats and skipped."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar_no, last, *bar = state.get if state.exists else (0, -1, *[None] * 9)
        rows = []
        for i, price, qty, quote, ts in chain.from_iterable(zip(*(p[c] for c in ("trade_id", "price", "qty", "quote_qty", "ts"))) for p in ascending(parts)):
            if i <= last:
                continue
            last = int(i)
            ts = ts.to_pydatetime()
            bar = [ts, ts, price, price, price, price, qty, quote, 1] if bar[8] is None else [bar[0], max(bar[1], ts), bar[2], max(bar[3], price), min(bar[4], price), price, bar[5 + 1] + qty, bar[7] + quote, bar[8] + 1]
            if bar[7] >= threshold:
                rows.append((key[0], bar_no, *bar))
                bar_no, bar = bar_no + 1, [None] * 9
        state.update((bar_no, last, *bar))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BAR.split(", ")])

    return in_order(trades).groupBy("symbol").applyInPandasWithState(step, BAR, STATE, "append", GroupStateTimeout.NoTimeout)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def drained(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """What a stream yields from all that is there now, by way of files in the shared folder. With the folder of an earlier call the stream goes on from where that ended, and the rows of both are given."""
    spark = stream.sparkSession
    folder = folder or f"{shared(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    own = {"spark.sql.streaming.stateStore.providerClass": ROCKS, UNCHECKED: "false"}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():  # a query takes the settings of its start
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    query.awaitTermination()
    return spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out").drop("batch")
