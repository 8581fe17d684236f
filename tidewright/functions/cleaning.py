"""Cleaning of feature frames before training or stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nan_to_num(column: str, value: float = 0.0) -> Column:
    """The column with NaN and infinities as `value`; nulls stay."""
    x = F.col(column)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), value).otherwise(x)


def drop_incomplete(df: DataFrame, critical: list[str] | None = None) -> DataFrame:
    """Rows that have all critical columns, or all columns where none are named."""
    return df.na.drop(subset=critical)


def remap_labels(label: Column) -> Column:
    """-1, 0, 1 as the classes 0, 1, 2."""
    return (label + 1).cast("int")


def common_columns(*frames: DataFrame) -> list[str]:
    """Columns that all frames have, in the first one's order."""
    return [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
