"""What several operators share: hash keys, ordered prefix sums, components, Arrow passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

#: Rows an Arrow pass handles at a time, so that long texts stay within a worker's memory.
SLICE = 64
#: Spark's switch for removing the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; its shuffle files, which
    nothing reads again, go at once and not when the driver happens to collect its garbage."""
    session = df.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(checkpoint_dir(session))
    before = session.conf.get(CLEANUP, None)
    session.conf.set(CLEANUP, "true")
    try:
        # The switch is read where a plan is made, so this takes a plan of its own.
        return df.select("*").checkpoint()
    finally:
        if before is None:
            session.conf.unset(CLEANUP)
        else:
            session.conf.set(CLEANUP, before)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_key(seed: str, *parts: Column) -> Column:
    """Reproducible random order: md5 of the seed and the parts as text (nulls left out)."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]))


def unit(key: Column) -> Column:
    """The first 48 bits of an md5 text as a number from 0 to below 1, in the same order."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)


def source_key(source: Column) -> Column:
    """A group key that is never null; null sorts last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def bucket_count(rows: int) -> int:
    """Ranges for ordered prefix sums: the square root of the rows, so that neither the
    rows of one range nor the table of ranges grows as fast as the input."""
    return max(1, math.isqrt(rows))


def running_total(rows: DataFrame, group: list[str], place: Column, order: list[Column], value: Column, out: str, buckets: int) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows before each row of its group.

    ``place`` (0 to 1) must not decrease along ``order``. It deals the rows into ranges;
    each range is summed by its own task, and the ranges' totals, a small table, are
    summed along each group. No group, however large, meets in one task.
    """
    cell = free_name(rows, "cell")
    before = free_name(rows, "cell_before")
    rows = rows.withColumn(cell, F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int")).withColumn(out, value.cast("long"))
    keys = [*group, cell]
    totals = rows.groupBy(*keys).agg(F.sum(out).alias(before))
    along = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn(before, F.coalesce(F.sum(before).over(along), F.lit(0)))
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum(out).over(within), F.lit(0)))
    return rows.join(totals, keys).withColumn(out, F.col(out) + F.col(before)).drop(cell, before)


def arrow_pass(df: DataFrame, added: str, work: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], keep: list[str] | None = None) -> DataFrame:
    """Appends columns computed from slices of rows in Python.

    ``work`` is called once per task and returns the function that turns a slice into
    the arrays of the ``added`` columns (a DDL text). ``keep`` limits what is passed on.
    """
    extra = T.StructType.fromDDL(added)
    kept = [f for f in df.schema.fields if keep is None or f.name in keep]
    schema = T.StructType([*kept, *extra.fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *step(part)], names)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (id, component), the smallest id
    reachable, for every id that has an edge.

    Alternates the large-star and small-star steps: each joins a node's neighbours to the
    smallest of them. Both are a grouped minimum and an equi-join, so a star with very many
    leaves is combined before the shuffle and split by adaptive joins. The edges are kept in
    the checkpoint folder between rounds; the loop ends when a round changes nothing.
    """
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = settled(small.where("a <> b").distinct())
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first()
        if state[0] == state[2] and state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
