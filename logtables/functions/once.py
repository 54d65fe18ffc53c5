"""Costly columns that must be computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column behind a one-row generator.

    The optimizer copies the expression of a projected column into every filter
    it pushes below; behind a generator a filter sees the finished value.
    """
    rest = [F.col(c) for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))
