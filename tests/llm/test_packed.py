"""Texts that a shuffle takes along are compressed; chunks carry their size in their digest."""

import numpy as np
import pyarrow as pa

from tidewright.llm import chunk_dedup
from tidewright.llm.common import packed, unpacked, utf8, with_columns
from pyspark.sql import types as T

TEXTS = ["", None, "a", "\x00é\U0001f600" * 50, "some words " * 400]


def test_packed_texts_come_back(spark):
    df = spark.createDataFrame([(i, t, float(i)) for i, t in enumerate(TEXTS)], "k int, text string, x double")
    small = packed(df)
    assert small.schema["text"].dataType == T.BinaryType() and small.columns == df.columns
    assert len({r["k"]: r["text"] for r in small.collect()}[4]) < 200
    assert sorted(small.mapInArrow(unpacked, df.schema).collect()) == sorted(df.collect())
    sized = with_columns(small, lambda batch, data, starts: {"n": pa.array(np.diff(starts))}, [T.StructField("n", T.LongType())], small=True)
    assert {r["k"]: (r["text"], r["x"], r["n"]) for r in sized.collect()} == {i: (t, float(i), len((t or "").encode())) for i, t in enumerate(TEXTS)}


def test_digests_hold_the_size():
    data, starts = utf8(pa.array(["words and more words that go on, " * 40, "x" * 1_000, "é" * 333]))
    begin, end, _ = chunk_dedup.spans_of(data, starts)
    c1, c2 = chunk_dedup.hashes_of(data, begin, end)
    assert ((c2 & (1 << chunk_dedup.SIZE_BITS) - 1) == end - begin).all() and chunk_dedup.MOST < 1 << chunk_dedup.SIZE_BITS
    assert len(set(zip(c1.tolist(), c2.tolist()))) == len({data[a:b].tobytes() for a, b in zip(begin, end)})
