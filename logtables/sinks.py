"""Where finished rows go."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import lean_writes

Sink = Callable[[DataFrame], None]


def events_as_json(events: DataFrame) -> DataFrame:
    """``queue`` and the event as JSON text."""
    body = F.to_json(F.struct("collector", "metadata", "payload", "timestamp"))
    return events.select(F.col("collector.queue").alias("queue"), body.alias("value"))


def write_events(events: DataFrame, folder: str) -> None:
    """Log events as JSON lines, one subfolder per queue.

    The folder is replaced, so a repeated pass leaves one copy.
    """
    events_as_json(events).write.mode("overwrite").partitionBy("queue").text(folder)


def sink_metrics(events: DataFrame, sink: Sink | str, compression: str = "none") -> None:
    """Hand metric events to a sink: a function, or a folder for JSON lines.

    ``compression`` is the codec of a folder's files; Spark reads them by their names.
    """
    if callable(sink):
        sink(events)
        return
    named = events.select(F.col("metadata.name").alias("name"), F.to_json(F.struct("metadata", "fields", "timestamp")).alias("value"))
    with lean_writes(events.sparkSession):
        named.write.mode("overwrite").option("compression", compression).partitionBy("name").text(sink)
