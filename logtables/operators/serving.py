"""Log files and events as answers to a viewer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import position_lines
from ..sources.listing import list_files
from ..sources.ranges import count_lines


def list_log_files(spark: SparkSession, folders: Sequence[str]) -> tuple[DataFrame, list[dict[str, str]]]:
    """Files directly in the folders with size, time and rows, and folders that failed."""
    good, errors = [], []
    for folder in dict.fromkeys(f.rstrip("/") or "/" for f in folders):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path) and fs.getFileStatus(path).isDirectory():
            good.append(folder)
        else:
            errors.append({"logs_path": folder, "error": f"failed to read search logs directory [{folder}]"})
    if not good:
        empty = "name string, logs_path string, size_in_bytes bigint, modify_time timestamp, total_rows bigint"
        return spark.createDataFrame([], empty), errors
    files = list_files(spark, good, recursive=False)
    rows = files.join(count_lines(files), "path", "left").withColumn("total_rows", F.coalesce("total_rows", F.lit(0)))
    return (
        rows.select(
            "name",
            F.regexp_replace("walked", "/[^/]*$", "").alias("logs_path"),
            F.col("size").alias("size_in_bytes"),
            F.col("mtime").alias("modify_time"),
            "total_rows",
        ),
        errors,
    )


def read_page(lines: DataFrame, path: str, start_line: int, count: int) -> DataFrame:
    """One page of one file; ``eof`` when fewer than ``count`` lines were left."""
    first = max(start_line, 1)
    one = lines.filter(F.col("path") == path)
    if "line_no" not in one.columns:
        one = position_lines(one)
    page = one.filter(F.col("line_no").between(first, first + count - 1))
    page = page.select("path", "line_no", F.col("line").alias("content"), "bytes", "end_offset")
    # At most `count` rows meet here.
    return page.withColumn("eof", F.count(F.lit(1)).over(Window.partitionBy("path")) < count).orderBy("line_no")


def read_pages(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """A page per request (``request_id, path, start_line, lines``) in one join.

    A request is spelled out as the line numbers it wants, so that the join is on
    single lines and a file asked for many times is not paired with itself. An
    estimate counts requests, not their lines, so a merge is asked for: a broadcast
    would hold every line number on the driver.
    """
    first = F.greatest(F.col("start_line"), F.lit(1)).cast("bigint")
    wanted = requests.filter(F.col("lines") > 0).select(
        "request_id", "path", F.col("lines").alias("_asked"),
        F.explode(F.sequence(first, first + F.col("lines").cast("bigint") - 1)).alias("line_no"),
    )
    page = lines.join(wanted.hint("merge"), ["path", "line_no"])
    # A page's rows meet here, never more than were asked for.
    left = F.count(F.lit(1)).over(Window.partitionBy("request_id"))
    return page.select(
        "request_id", "path", "line_no", F.col("line").alias("content"), "bytes", "end_offset", (left < F.col("_asked")).alias("eof")
    )


def shape_line_numbers(df: DataFrame, column: str = "line_numbers") -> DataFrame:
    """Export form: one number as a scalar, several as a list."""
    c = F.col(column)
    return df.withColumn(
        column, F.when(F.size(c) == 1, F.get(c, F.lit(0)).cast("string")).otherwise(F.to_json(c))
    )


def filter_by_level(events: DataFrame, levels: Sequence[str], column: str = "level") -> DataFrame:
    return events.filter(F.col(column).isin(list(levels)))


def sample_documents(df: DataFrame, n: int, key: str, by: str | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by a hash of ``key``, the same on every run.

    With ``by``, ``n`` rows per value: each task keeps its own ``n`` smallest
    first, so only those are shuffled to the final choice.
    """
    marked = df.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key).cast("string")))
    if by is None:
        return marked.orderBy("_h", key).limit(n).drop("_h")
    order = Window.partitionBy(by).orderBy("_h", key)
    return marked.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_h", "_r")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per task."""
    df.write.mode("overwrite").option("header", True).csv(path)
