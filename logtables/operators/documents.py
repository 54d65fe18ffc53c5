"""Small texts handled whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def strip_comments(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop lines beginning with ``#`` and put the rest together without separator.

    A document is one row, so nothing is shuffled.
    """
    kept = F.filter(F.split(F.col(column), "\r?\n", -1), lambda x: ~x.startswith("#"))
    return df.withColumn(column, F.array_join(kept, ""))
