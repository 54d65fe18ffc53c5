"""Pages of log files through a sparse index of their lines.

The index has a row per byte range of a file: where it starts and which line that is. A page
opens the one or two ranges that hold its lines. A file that grew is counted from its last whole
range on. Ranges of a gzip file cannot be entered, so it is one range, unpacked up to the page's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ranges import OPEN_END, RANGE_BYTES, REPLACED, count_terminators, read_lines, spread
from .serving import read_pages

#: Lines that share a key where pages meet ranges.
_BIN = 16_384
_LINES = "path string, line_no bigint, line string, bytes bigint, end_offset bigint"


def index_lines(listing: DataFrame, index: DataFrame | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, inode, start, end, last, lines, first_line``, a row per range of each file.

    ``lines`` counts the terminators in the range, ``first_line`` is the number of the line the
    first of them ends, ``last`` marks the range at the file's end. Of a former ``index``, made with
    the same ``range_bytes``, whole ranges of files that are still the same are taken over; a
    file that is replaced or shorter is counted anew.
    """
    files = listing.select("path", F.coalesce("inode", F.lit("")).alias("inode"), F.col("size").cast("bigint").alias("size"))
    packed = F.col("path").endswith(".gz")
    known = None
    if index is not None:
        whole = index.filter(~packed & (F.col("end") - F.col("start") == range_bytes)).select("path", "inode", "start", "end", "lines")
        same = files.filter("inode != ''").groupBy("path", "inode").agg(F.max("size").alias("size"))
        shrunk = index.groupBy("path", "inode").agg(F.max("end").alias("_end")).join(same, ["path", "inode"]).filter("_end > size")
        whole = whole.join(shrunk, ["path", "inode"], "left_anti")
        known = whole.join(same, ["path", "inode"]).select("path", "inode", "start", "end", "size", "lines")
        done = known.groupBy("path").agg(F.max("end").alias("_from"))
        files = files.join(done, "path", "left").withColumn("_from", F.coalesce("_from", F.lit(0)))
    else:
        files = files.withColumn("_from", F.lit(0).cast("bigint"))
    step = F.when(packed, F.col("size")).otherwise(F.lit(range_bytes)).cast("bigint")
    start = F.explode(F.sequence(F.col("_from").cast("bigint"), F.col("size") - 1, step))
    ranges = files.filter(F.col("size") > F.col("_from")).select("path", "inode", start.alias("start"), "size", step.alias("_step"))
    ranges = ranges.select("path", "inode", "start", F.least(F.col("start") + F.col("_step"), F.col("size")).alias("end"), "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_terminators(r["path"], r["start"], r["end"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "lines"])

    counted = spread(ranges).mapInArrow(run, "path string, inode string, start bigint, end bigint, size bigint, lines bigint")
    rows = counted if known is None else known.unionByName(counted)
    # One row per range, not per line, meets here.
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select(
        "path", "inode", "start", "end", (F.col("end") == F.col("size")).alias("last"), "lines",
        (F.coalesce(before, F.lit(0)) + 1).alias("first_line"),
    )


def ranges_of_pages(index: DataFrame, requests: DataFrame) -> DataFrame:
    """The ranges that hold lines of a page, each once, with the lowest and highest line wanted of it.

    Pages and ranges meet on (path, bin of lines), so a long file with many pages is no pair of
    everything with everything.
    """
    low = F.greatest(F.col("start_line"), F.lit(1)).cast("bigint")
    wanted = requests.filter(F.col("lines") > 0).select("path", low.alias("low"), (low + F.col("lines") - 1).alias("high")).distinct()
    wanted = wanted.withColumn("bin", F.explode(F.sequence(F.expr(f"low div {_BIN}"), F.expr(f"high div {_BIN}"))))
    # The end of a file may be a line without terminator.
    final = F.col("first_line") + F.col("lines") - 1 + F.col("last").cast("bigint")
    ranges = index.withColumn("final", final).filter(F.col("final") >= F.col("first_line"))
    bins = F.explode(F.sequence(F.expr(f"first_line div {_BIN}"), F.expr(f"final div {_BIN}")))
    ranges = ranges.select("path", "inode", "start", "end", "last", "first_line", "final", bins.alias("bin"))
    # Both sides are larger than estimates say, which do not see the bins; neither is broadcast.
    met = ranges.join(wanted.hint("merge"), ["path", "bin"]).filter("low <= final and high >= first_line")
    return met.groupBy("path", "inode", "start", "end", "last", "first_line").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def indexed_lines(ranges: DataFrame, limit: int | None = RANGE_BYTES) -> DataFrame:
    """``path, line_no, line, bytes, end_offset`` of the lines from ``low`` to ``high`` of each range.

    A range is left once its highest line is read. A line over ``limit`` bytes keeps its number and
    has no text. A file that is gone, or another one since it was indexed, has no lines.
    """

    def lines_of(row: dict) -> Iterator[pa.RecordBatch]:
        number = row["first_line"]
        for batch in read_lines(row["path"], row["start"], row["end"], row["last"], limit, row["inode"] or None):
            kept = []
            for begin, stop, line, reason in zip(*(batch.column(c).to_pylist() for c in ("offset", "end_offset", "line", "reason"))):
                if reason in (OPEN_END, REPLACED):
                    continue
                if row["low"] <= number <= row["high"]:
                    text = None if line is None else line.decode("utf-8", "replace")
                    kept.append((row["path"], number, text, None if begin is None else stop - begin, stop))
                number += 1
            columns = list(zip(*kept)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            names = ["path", "line_no", "line", "bytes", "end_offset"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
            if number > row["high"]:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    yield from lines_of(row)
                except FileNotFoundError:
                    continue

    # Pages touch few ranges; the number keeps adaptive plans from reading them in one task.
    tasks = ranges.sparkSession.sparkContext.defaultParallelism * 4
    return ranges.repartition(tasks, "path", "start").mapInArrow(run, _LINES)


def pages_by_index(index: DataFrame, requests: DataFrame, limit: int | None = RANGE_BYTES) -> DataFrame:
    """``read_pages`` of files that an index covers: only the pages' ranges are read."""
    return read_pages(indexed_lines(ranges_of_pages(index, requests), limit), requests)
