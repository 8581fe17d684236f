"""What the text operators share: reading tables, cutting lineage, and vectorised work on UTF-8 bytes."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text and texts that one vectorised step takes at once; a longer text makes a step of its own.
STEP_BYTES, STEP_ROWS = 1 << 20, 2_000
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse, which driver and executors share as well."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written once to the shared checkpoint folder, so that a lost executor costs no earlier stage."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again: Spark then knows its size, where cut() keeps the estimate made before."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffles(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_id(column: str = "doc_id"):
    """The id as a long that sorts nulls after all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST_ID))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """df with part, written once: a part holds rows that follow one another by `order` (ascending, nulls first), and parts ascend."""
    return cut(df.repartitionByRange(shuffles(df), *order).withColumn("part", F.spark_partition_id()))


def with_neighbours(rows: DataFrame, value, *order: str, wrap: bool = False) -> DataFrame:
    """rows of in_order() with previous and next: the struct `value` of the row before and after; null beyond the ends, or with wrap the last row's and the first row's.

    Rows look around inside their part; only each part's first and last row go to the parts beside it, so what one task
    orders over all parts is as many rows as there are parts.
    """
    key = F.struct(*order)
    ends = rows.groupBy("part").agg(F.min_by(value, key).alias("first"), F.max_by(value, key).alias("last"))
    every = Window.orderBy("part")
    before, after = F.lag("last").over(every), F.lead("first").over(every)
    if wrap:
        whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        before, after = F.coalesce(before, F.last("last").over(whole)), F.coalesce(after, F.first("first").over(whole))
    # a row for each part: no more rows than shuffle partitions
    joined = rows.join(F.broadcast(ends.select("part", before.alias("_before"), after.alias("_after"))), "part")
    inside = Window.partitionBy("part").orderBy(*order)
    return joined.withColumns({"previous": F.coalesce(F.lag(value).over(inside), "_before"), "next": F.coalesce(F.lead(value).over(inside), "_after")}).drop("_before", "_after")


# ---- texts as bytes ---------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after the other, and where each text starts (one more entry than texts). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, starts, data = column.buffers()
    n, off = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(starts, np.int64)[off : off + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def steps(batches, text: str = "text", most: int = STEP_BYTES, rows: int = STEP_ROWS):
    """(batch, bytes, starts) of at most `most` bytes of text and `rows` texts each, or of one text."""
    for batch in batches:
        data, starts = utf8(batch.column(text))
        n, at = len(starts) - 1, 0
        while at < n:
            to = min(at + rows, max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1))
            yield batch.slice(at, to - at), data[starts[at] : starts[to]], starts[at : to + 1] - starts[at]
            at = to


def slices(batches, rows: int = 200):
    """Batches of at most `rows` rows, for work that turns them into Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """df with its texts compressed one by one, for a shuffle that takes texts along; null stays null. unpacked() reads them."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    at = df.columns.index(text)
    schema = StructType([StructField(text, BinaryType()) if i == at else f for i, f in enumerate(df.schema.fields)])

    def run(batches):
        for batch in slices(batches):
            small = [None if x is None else zlib.compress(x, 1) for x in batch.column(at).cast(pa.large_binary()).to_pylist()]
            yield batch.set_column(at, text, pa.array(small, pa.binary()))

    return df.mapInArrow(run, schema)


def unpacked(batches, text: str = "text"):
    """Batches of rows of packed() with their texts, a few rows at a time."""
    for batch in slices(batches):
        at = batch.schema.get_field_index(text)
        yield batch.set_column(at, text, pa.array([None if x is None else zlib.decompress(x) for x in batch.column(at).to_pylist()], pa.large_binary()).cast(pa.large_string()))


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# ---- hashes -----------------------------------------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240611))
#: A random 64-bit number for each byte value, for two independent hashes and the rolling hash.
BYTE_CODES = _rng.integers(0, 1 << 64, size=(3, 256), dtype=np.uint64)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over the word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i up to n."""
    global _powers
    if len(_powers[0]) <= n:
        up, down = np.full(n + 1, _BASE), np.full(n + 1, _INVERSE)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


class Spans:
    """Hashes of any spans of some bytes, each in constant time: sums of code * base^i, shifted back to the span's start."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[which][data] * self.up[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, starts: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words start and end, and how many each text has. Words are runs without white space; none runs from a text into the next."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = separator[data]
    first = gap[:-2] & ~gap[1:-1]
    last = ~gap[1:-1] & gap[2:]
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = ~gap[1:-1][inner]
    last[inner - 1] = ~gap[1:-1][inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.diff(np.searchsorted(begin, starts))


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1 and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_digest(spans: Spans, starts: np.ndarray) -> np.ndarray:
    return signed(spans.hash(starts[:-1], starts[1:]))


# ---- adding columns ---------------------------------------------------------------------------


def with_columns(df: DataFrame, make, fields, text: str = "text", most: int = STEP_BYTES, small: bool = False) -> DataFrame:
    """df with the columns that make(batch, bytes, starts) returns as a dict; a column of df that has such a name is replaced.

    small: df's texts are packed(); they come out whole. fields: the new columns as Spark's StructFields. make() runs in Python workers, on steps of bounded size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    names = {f.name for f in fields}
    kept = [StructField(text, StringType()) if small and f.name == text else f for f in df.schema.fields if f.name not in names]
    schema = StructType(kept + list(fields))
    arrow = to_arrow_schema(schema)
    old = [f.name for f in kept]

    def run(batches):
        for batch, data, starts in steps(unpacked(batches, text) if small else batches, text, most):
            new = make(batch, data, starts)
            columns = [batch.column(n) for n in old] + [new[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def texts_of(data: np.ndarray, starts: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def shielded(docs: DataFrame, needed: tuple[str, ...], work) -> DataFrame:
    """work(docs) with docs' columns in their order, where work may add columns of any name: those of docs that it doesn't need have other names meanwhile."""
    names = {c: c if c in needed else f"_x{i}" for i, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return work(inner).select(*[F.col(n).alias(c) for c, n in names.items()])
