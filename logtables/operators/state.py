"""What changed since the last pass, and the state the next one needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "path string, name string, size bigint, mtime timestamp, inode string, resume_offset bigint"


def resolve_links(listing: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Replace a link by its target's path and stat; a file reached twice counts once.

    ``targets`` holds the stat of link targets (``path, size, mtime, inode``);
    without it the listing's own stat is taken as the target's.
    """
    stat = [c for c in ("size", "mtime", "inode") if c in listing.columns]
    df = listing.withColumn("_walk", F.col("path")).withColumn("path", F.coalesce("link_target", "path"))
    if targets is not None:
        real = targets.select("path", *[F.col(c).alias(f"_{c}") for c in stat])
        df = df.join(real, "path", "left")
        dangling = F.col("link_target").isNotNull() & F.col(f"_{stat[0]}").isNull()
        df = df.filter(~dangling).withColumns(
            {c: F.when(F.col("link_target").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in stat}
        )
    rest = [c for c in listing.columns if c not in ("path", "link_target")]
    return df.groupBy("path").agg(F.min_by(F.struct(*rest), "_walk").alias("_f")).select("path", "_f.*")


def classify_changes(listing: DataFrame, state: DataFrame) -> DataFrame:
    """``op`` per changed file: create, truncate or write; unchanged files are left out.

    A new or replaced file is a create. With a new modification time a file that
    did not grow counts as truncated, any other as written.
    """
    old = state.select(
        "path",
        F.col("size").alias("_size"),
        F.col("mtime").alias("_mtime"),
        F.col("inode").alias("_inode"),
        F.col("resume_offset").alias("_offset"),
    )
    known = F.col("_inode").isNotNull() & (F.col("_inode") == F.col("inode"))
    op = (
        F.when(~F.coalesce(known, F.lit(False)), F.lit("create"))
        .when((F.col("mtime") != F.col("_mtime")) & (F.col("_size") >= F.col("size")), F.lit("truncate"))
        .when(F.col("mtime") != F.col("_mtime"), F.lit("write"))
    )
    joined = listing.join(old, "path", "left").withColumn("op", op).filter(F.col("op").isNotNull())
    return resume_offsets(joined)


def resume_offsets(changes: DataFrame) -> DataFrame:
    """Where reading starts: the stored offset for a written file, else 0."""
    written = F.col("op") == "write"
    start = F.when(written, F.coalesce(F.col("_offset"), F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    return changes.withColumn("start_offset", start).drop("_size", "_mtime", "_inode", "_offset")


def advance_state(state: DataFrame, read: DataFrame) -> DataFrame:
    """State after a pass: what was read replaces what was known, per path."""
    names = [c for c in state.columns if c != "path"]
    new = read.select("path", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_read"))
    hit = F.coalesce(F.col("_read"), F.lit(False))
    return state.join(new, "path", "full_outer").select(
        "path", *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names]
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Finished state versions, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    return sorted(v for v in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/v={v}/_SUCCESS")))


def load_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The newest complete version, of those before a number if one is given, or an empty table."""
    versions = [v for v in _versions(spark, folder) if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(f"{folder}/v={versions[-1]}")


def save_state(state: DataFrame, folder: str, keep: int = 8, version: int | None = None) -> int:
    """Write the next version, or the given one again; an interrupted write is never read.

    The newest ``keep`` complete versions stay. At least two do, since the table just written may
    still be read through its predecessor. Older ones are removed only after the new one is whole.
    """
    if keep < 2:
        raise ValueError("keep at least two versions")
    spark = state.sparkSession
    versions = _versions(spark, folder)
    version = version or (versions[-1] if versions else 0) + 1
    state.write.mode("overwrite").parquet(f"{folder}/v={version}")
    _drop_versions(spark, folder, [*[v for v in versions if v < version], version][:-keep])
    return version


def _drop_versions(spark: SparkSession, folder: str, versions: list[int]) -> None:
    """Remove versions, the mark of completeness first, so that a half removed one is never read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for v in versions:
        target = path(f"{folder}/v={v}")
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path(f"{folder}/v={v}/_SUCCESS"), False)
        fs.delete(target, True)
