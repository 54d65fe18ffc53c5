"""Continuous event assembly.

Every micro-batch is assembled by the batch operator, so a busy file is spread
over many tasks here too. Between batches only the open event of each path is
kept, as one row of a table in the stream's folder; a batch that is repeated
after a failure reads the same table version again.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.match import matches
from ..operators.assemble import MAX_BYTES, MAX_LINES, assemble_joined
from ..operators.ordered import number_lines

IDLE_SECONDS = 5.0
CARRY = (
    "path string, line string, probe string, weight bigint, full_size bigint, bytes bigint, "
    "offset bigint, end_offset bigint, multiline boolean, seen double"
)

Deliver = Callable[[DataFrame, int], None]


def _read_carry(spark: SparkSession, folder: str, batch_id: int) -> DataFrame:
    """The open events the batch before ``batch_id`` left."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{folder}/open")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = sorted(
        int(n[6:]) for n in names
        if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/open/{n}/_SUCCESS"))
    )
    older = [b for b in done if b < batch_id]
    if not older:
        return spark.createDataFrame([], CARRY)
    for b in older[:-2]:
        _drop(spark, f"{folder}/open/batch={b}")
    return spark.read.schema(CARRY).parquet(f"{folder}/open/batch={older[-1]}")


def _drop(spark: SparkSession, folder: str) -> None:
    """Remove a table no batch can ask for any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def assemble_batch(
    lines: DataFrame,
    carry: DataFrame,
    now: float,
    pattern: str,
    negate: bool = True,
    match: str = "after",
    flush_pattern: str | None = None,
    idle: float = IDLE_SECONDS,
    max_lines: int = MAX_LINES,
    max_bytes: int = MAX_BYTES,
    separator: str = "\n",
) -> DataFrame:
    """Events of carried and new lines, with ``open`` for those still waiting.

    The carried part of an event comes in as one line that counts as many.
    """
    new = lines.select(
        "path", F.col("chunk").cast("bigint").alias("chunk"), "line", F.col("line").alias("probe"),
        F.lit(1).cast("bigint").alias("weight"),
        F.octet_length("line").cast("bigint").alias("full_size"), F.col("bytes").cast("bigint").alias("bytes"),
        "offset", "end_offset", F.lit(False).alias("multiline"), F.lit(float(now)).alias("seen"),
    )
    old = carry.select(F.col("path"), F.lit(-1).cast("bigint").alias("chunk"), *[c for c in carry.columns if c != "path"])
    rows = number_lines(old.unionByName(new), ["offset"], "_row")
    # The carried row takes the number of its last stored line.
    shift = old.select("path", (F.least("weight", F.lit(max_lines)) - 1).alias("_shift"))
    rows = rows.join(shift, "path", "left").withColumn("line_no", F.col("_row") + F.coalesce("_shift", F.lit(0)))
    rows = rows.drop("_row", "_shift")
    carried = F.col("chunk") < 0
    joins = F.coalesce(matches("probe", pattern), F.lit(False))
    joins = ~joins if negate else joins
    flush: Column | None = None
    if flush_pattern is not None:
        flush = ~carried & F.coalesce(matches("probe", flush_pattern), F.lit(False))
    closing = F.lit(False) if flush is None else F.coalesce(F.max_by("_closes", "line_no"), F.lit(False))
    aggregates = [
        F.max("seen").alias("seen"),
        F.bool_or("multiline").alias("_multi"),
        F.max_by("probe", "line_no").alias("probe"),
        closing.alias("_closed"),
    ]
    events = assemble_joined(rows, joins, match, flush, max_lines, max_bytes, separator, False, aggregates)
    last = events.groupBy("path").agg(F.max("line_from").alias("_last"))
    events = events.join(last, "path")
    waiting = (F.col("line_from") == F.col("_last")) & ~F.col("_closed") & (F.lit(float(now)) - F.col("seen") < idle)
    flags = F.when(
        F.col("_multi") & ~F.array_contains("flags", "multiline"), F.array_append("flags", F.lit("multiline"))
    ).otherwise(F.col("flags"))
    return events.withColumns({"open": waiting, "flags": flags}).drop("_last", "_closed", "_multi")


def assemble_stream(
    lines: DataFrame,
    folder: str,
    deliver: Deliver,
    pattern: str,
    idle: float = IDLE_SECONDS,
    clock: Callable[[], float] = time.time,
    heartbeat: bool = False,
    **options,
) -> DataStreamWriter:
    """A stream writer that hands finished events to ``deliver(events, batch_id)``.

    An event without a new line for ``idle`` seconds is handed over as it is.
    ``heartbeat`` makes batches happen while no file grows, so that the last
    event of a quiet file is not kept waiting.
    """
    spark = lines.sparkSession
    columns = ["path", "chunk", "offset", "end_offset", "line", "bytes"]
    if heartbeat:
        beat = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in lines.select(columns).schema.fields}
        lines = lines.select(columns).unionByName(beat.select(*empty.values()))

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        carry = _read_carry(session, folder, batch_id)
        # The source is read once; assembly looks at the lines several times.
        fresh = batch.filter(F.col("path").isNotNull())
        landed = f"{folder}/lines/batch={batch_id}"
        fresh.write.mode("overwrite").parquet(landed)
        new = session.read.schema(fresh.schema).parquet(landed)
        events = assemble_batch(new, carry, clock(), pattern, idle=idle, **options)
        # Written once: delivery and the next carry come from the same rows.
        staged = f"{folder}/events/batch={batch_id}"
        events.write.mode("overwrite").parquet(staged)
        events = session.read.parquet(staged)
        keep = events.filter("open").selectExpr(
            "path", "content as line", "probe", "lines as weight",
            "cast(octet_length(content) + if(array_contains(flags, 'truncated'), 1, 0) as bigint) as full_size", "bytes", "offset", "end_offset",
            "array_contains(flags, 'multiline') as multiline", "seen",
        )
        keep.write.mode("overwrite").parquet(f"{folder}/open/batch={batch_id}")
        deliver(events.filter("not open").drop("open", "probe", "seen"), batch_id)
        _drop(session, landed)
        _drop(session, f"{folder}/events/batch={batch_id - 2}")

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
