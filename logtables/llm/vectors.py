"""Reading vectors the same way for every operator on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_key, unit

#: Vectors a model of the data (means, rotations, cell borders) is fitted on, at most about.
SAMPLE = 8192


def one_per_id(rows: DataFrame, *others: str) -> DataFrame:
    """vec_id, the other columns and ``vector`` (array of double, null where it takes no
    part: null, empty, zero, with null or non-finite components, or of another length than
    most). Rows with one id are one vector, the least of them."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    usable &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable &= F.exists("embedding", lambda x: x != 0)
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        *[F.col(c) for c in others],
        F.when(usable, F.col("embedding").cast("array<double>")).alias("vector"),
    )
    best = F.min(F.struct(F.col("vector").isNull().alias("none"), *others, "vector")).alias("best")
    rows = rows.groupBy("vec_id").agg(best).select("vec_id", *[f"best.{c}" for c in (*others, "vector")])
    lengths = rows.where("vector is not null").groupBy(F.size("vector").alias("n")).count()
    first = lengths.orderBy(F.desc("count"), "n").first()
    same = F.size("vector") == (first.n if first else 0)
    return rows.withColumn("vector", F.when(same, F.col("vector")))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length, none of them null, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sample(rows: DataFrame, seed: str, total: int, most: int = SAMPLE) -> np.ndarray:
    """Distinct vectors of about ``most`` rows (vec_id, vector), chosen by hash of the id."""
    share = 1.0 if total <= most else most / total
    found = rows.where(unit(hash_key(seed, F.col("vec_id"))) < share).select("vector").toArrow()
    return np.unique(matrix(found.column("vector")), axis=0) if found.num_rows else np.zeros((0, 1))
