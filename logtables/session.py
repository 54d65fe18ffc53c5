"""Session settings the operators rely on."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

#: Runtime settings that change results (zone, codecs) or keep plans adaptive.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Long texts by the thousand stay within a Python worker's memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


#: Contexts that have been given the package.
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, wherever the driver runs; once per context."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / home.name), "zip", home.parent, home.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere, and ship the package."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


#: Spark's switch for removing the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Files of so many subfolders a task writes side by side; only for more are its rows sorted.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def lean_writes(spark: SparkSession) -> Iterator[None]:
    """What is planned in here removes its shuffle files when it ends, not when the driver happens
    to collect its garbage, and does not sort rows for a few subfolders."""
    before = {key: spark.conf.get(key, None) for key in (CLEANUP, WRITERS)}
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(WRITERS, "8")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints and staging tables.

    A local folder is used only where the session names none, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="logtables-")
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def local_session(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logtables")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Small test data still uses every core.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
