"""A symbol's part of a micro-batch is read in sorted parts, never as a whole."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.streaming import features as V
from tidewright.streaming import trades as S


def test_parts_ascend():
    parts = [pd.DataFrame({"trade_id": range(a, b)}) for a, b in ((0, 25), (25, 26), (26, 60))]
    assert [len(p) for p in V.ascending(iter(parts), 10)] == [10, 10, 5, 1, 10, 10, 10, 4]
    with pytest.raises(ValueError):
        list(V.ascending(iter(parts[::-1])))
    with pytest.raises(ValueError):
        list(V.ascending(iter([parts[0].iloc[::-1]])))


def test_unsorted_files(spark, sf, tmp_path):
    """Unsorted files of one micro-batch give the bars of the sorted file."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(5).sortWithinPartitions(F.desc("event_id")).write.parquet(f"{tmp_path}/in")

    def rows(path):
        return sorted(map(tuple, S.drained(V.bar_features(S.read_events(spark, path))).collect()))

    before = spark.conf.get(V.UNCHECKED, None)
    assert rows(f"{tmp_path}/in") == rows(f"{sf}/events.parquet") != []
    assert spark.conf.get(V.UNCHECKED, None) == before
