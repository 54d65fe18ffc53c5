"""Queries that write files and read them back: passes, streams and sinks."""

from __future__ import annotations

import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import jobs
from ..functions.fields import as_text
from ..functions.timestamps import SEARCH_LOG_TIMESTAMPS
from ..operators import metrics as m
from ..operators.assemble import assemble
from ..operators.envelope import collector_literal, text_payload, wrap_log_event
from ..operators.pages import index_lines, pages_by_index
from ..operators.serving import export_csv
from ..session import lean_writes
from ..sinks import sink_metrics, write_events
from ..sources.catalogue import LogPattern
from ..sources.files import with_offsets
from ..sources.listing import list_files
from ..sources.snapshots import read_snapshots
from ..streaming.events import assemble_stream
from ..streaming.stateful import assemble_events
from ..streaming.tail import tail_stream
from .fixtures import Inputs, cte
from .metric_queries import _PER_NODE, node_docs
from .registry import query
from .source_queries import _TAGGED, staging, write_logs

_EVENTS = """, s as (select *, sum(case when starts_with(line, '[') then 1 else 0 end) over (partition by path order by line_no) as ev from fx_text_lines),
 e as (select path, string_agg(line, chr(10) order by line_no) as content, count(*) as lines from s group by path, ev)
"""
_STAMP = r"regexp_extract(content, '\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2},\d{3}')"


@query(
    "ingest_pass",
    cte("fx_text_lines") + _EVENTS + f"select 'multiline' as log_type, 'staged' as name, content as message, {_STAMP} as timestamp from e",
)
def _(i: Inputs):
    """Files of whole events, one pass, the written events read back."""
    logs, out = staging(i, "ingest"), staging(i, "ingested")
    write_logs(i, i.text_lines, logs, "line")
    pattern = LogPattern(
        r"^part-.*\.txt$", "multiline", metadata={"name": "staged"}, line_pattern=r"^\[", timestamp_patterns=SEARCH_LOG_TIMESTAMPS
    )
    jobs.collect_logs(i.spark, logs, [pattern], f"{out}/state", f"{out}/events", "now")
    event = F.from_json("value", "metadata map<string,variant>, payload map<string,variant>, timestamp string")
    rows = i.spark.read.text(f"{out}/events").select(event.alias("e"))
    return rows.select(
        as_text(F.col("e.metadata")["log_type"]).alias("log_type"),
        as_text(F.col("e.metadata")["name"]).alias("name"),
        as_text(F.col("e.payload")["message"]).alias("message"),
        "e.timestamp",
    )


_INGESTED = "metadata map<string,variant>, payload map<string,variant>, timestamp string"


@query(
    "collect_stream",
    cte("fx_text_lines") + _EVENTS + f"select 'multiline' as log_type, 'staged' as name, content as message, {_STAMP} as timestamp from e",
)
def _(i: Inputs):
    """The files of ``ingest_pass`` by a stream: a batch that leaves every file's last event open, one
    that finds the files quiet, and this one again from a checkpoint that does not know it was done."""
    logs, out = staging(i, "collected"), staging(i, "collect-out")
    write_logs(i, i.text_lines, logs, "line")
    pattern = LogPattern(
        r"^part-.*\.txt$", "multiline", metadata={"name": "staged"}, line_pattern=r"^\[", timestamp_patterns=SEARCH_LOG_TIMESTAMPS
    )

    def batch(idle: float, checkpoint: str) -> None:
        stream = jobs.collect_stream(i.spark, logs, [pattern], f"{out}/state", f"{out}/events", idle=idle)
        stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    batch(1e6, f"{out}/cp")
    batch(0.0, f"{out}/cp")
    forget_commit(i.spark, f"{out}/cp", 1)
    batch(0.0, f"{out}/cp")
    rows = i.spark.read.text(f"{out}/events").select(F.from_json("value", _INGESTED).alias("e"))
    return rows.select(
        as_text(F.col("e.metadata")["log_type"]).alias("log_type"),
        as_text(F.col("e.metadata")["name"]).alias("name"),
        as_text(F.col("e.payload")["message"]).alias("message"),
        "e.timestamp",
    )


def forget_commit(spark, checkpoint: str, batch: int) -> None:
    """As if the driver had died after a batch's work and before the note that it was done."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{batch}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False):
        raise FileNotFoundError(str(path))


@query("read_page_index", cte("fx_text_lines") + "select path, line_no, line, false as eof from fx_text_lines")
def _(i: Inputs):
    """All files in pages of 1,000 lines, each read through the index; the last page of a file is
    asked for as long as it is, so none is over the end."""
    logs = staging(i, "paged")
    write_logs(i, i.text_lines, logs, _TAGGED)
    listing = list_files(i.spark, logs).filter(F.col("name").rlike(r"^part-.*\.txt$"))
    index_lines(listing, range_bytes=256 * 1024).write.parquet(f"{logs}-index")
    index = i.spark.read.parquet(f"{logs}-index")
    total = index.groupBy("path").agg(F.sum("lines").alias("total"))
    start = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total"), F.lit(1000).cast("bigint")))
    requests = total.filter("total > 0").select("path", "total", start.alias("start_line"))
    requests = requests.select(
        F.concat_ws(":", "path", "start_line").alias("request_id"), "path", "start_line",
        F.least(F.lit(1000), F.col("total") - F.col("start_line") + 1).cast("int").alias("lines"),
    )
    part = F.split("content", "\t", 3)
    return pages_by_index(index, requests).select(
        part[0].alias("path"), part[1].cast("bigint").alias("line_no"), part[2].alias("line"), "eof"
    )


@query("tail_stream", cte("fx_text_lines") + "select path, line_no, line from fx_text_lines")
def _(i: Inputs):
    logs, out = staging(i, "tailed"), staging(i, "tail-out")
    write_logs(i, i.text_lines, logs, _TAGGED)
    stream = tail_stream(i.spark, logs, r"^part-.*\.txt$", range_bytes=256 * 1024)
    writer = stream.writeStream.format("parquet").option("path", f"{out}/lines").option("checkpointLocation", f"{out}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    part = F.split("line", "\t", 3)
    return i.spark.read.parquet(f"{out}/lines").select(
        part[0].alias("path"), part[1].cast("bigint").alias("line_no"), part[2].alias("line")
    )


@query("assemble_stream", cte("fx_text_lines") + _EVENTS + "select content, lines from e")
def _(i: Inputs):
    logs, out = staging(i, "streamed"), staging(i, "stream-out")
    write_logs(i, i.text_lines, logs, "line")
    stream = tail_stream(i.spark, logs, r"^part-.*\.txt$", range_bytes=256 * 1024)

    def deliver(events, batch_id):
        events.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")

    writer = assemble_stream(stream, out + "/stream", deliver, r"^\[", idle=0.0)
    writer.trigger(availableNow=True).start().awaitTermination()
    return i.spark.read.parquet(f"{out}/events").select("content", F.col("lines").cast("bigint").alias("lines"))


def _until(query, found, wanted: int, seconds: float = 600.0) -> None:
    """Lets a stream run until ``found()`` is what is wanted; its own failure comes first."""
    end = time.time() + seconds
    while found() < wanted:
        if query.exception() is not None:
            raise query.exception()
        if time.time() > end:
            raise TimeoutError(f"the stream has not delivered everything after {seconds} s")
        time.sleep(0.5)


@query("assemble_events", cte("fx_text_lines") + _EVENTS + "select path, content, lines from e")
def _(i: Inputs):
    """Every file in two batches, so that events are carried over; its last event comes by the timer,
    which is longer than a batch takes."""
    logs, out = staging(i, "halves"), staging(i, "events-out")
    size = (F.octet_length("line") + 1).cast("bigint")
    lines = i.text_lines.withColumn("bytes", size)
    lines = with_offsets(lines).withColumn("late", F.col("line_no") > F.max("line_no").over(Window.partitionBy("path")) / 2)
    lines = lines.select("path", "line", "bytes", "offset", "end_offset", "late")
    lines.write.parquet(f"{logs}/all")
    halves = i.spark.read.parquet(f"{logs}/all")
    total = halves.count()
    halves.filter("not late").write.parquet(f"{logs}/in")
    first = len(i.spark.read.parquet(f"{logs}/in").inputFiles())
    halves.filter("late").write.mode("append").parquet(f"{logs}/in")
    stream = i.spark.readStream.schema(halves.schema).option("maxFilesPerTrigger", first).parquet(f"{logs}/in")
    events = assemble_events(stream, pattern=r"^\[", idle=25.0)
    writer = events.writeStream.format("parquet").option("path", f"{out}/events").option("checkpointLocation", f"{out}/cp")
    query = writer.trigger(processingTime="500 milliseconds").start()

    def delivered() -> int:
        if not query.recentProgress:  # the table exists once a batch is through
            return 0
        return i.spark.read.schema("lines bigint").parquet(f"{out}/events").agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]

    try:
        _until(query, delivered, total)
    finally:
        query.stop()
    return i.spark.read.parquet(f"{out}/events").select("path", "content", F.col("lines").cast("bigint").alias("lines"))


@query(
    "read_snapshots",
    _PER_NODE + "select node_id, node_name as name, host, 'node_stats' as kind from d",
)
def _(i: Inputs):
    folder = staging(i, "snapshots")
    texts = node_docs(i, F.to_json).select(F.col("doc").alias("value"))
    # A compressed file is read by one task, so none gets long.
    texts.write.option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(folder)
    docs = read_snapshots(i.spark, folder, "node_stats")
    nodes = m.explode_nodes(docs.withColumn("timestamp", F.col("kind")))
    return nodes.select(
        "node_id", as_text(F.col("node")["name"]).alias("name"), as_text(F.col("node")["host"]).alias("host"),
        F.col("timestamp").alias("kind"),
    )


@query(
    "write_events",
    cte("fx_text_lines") + _EVENTS + "select 'audit' as queue, content as message, 'host-1' as hostname from e",
)
def _(i: Inputs):
    events = assemble(i.text_lines, r"^\[", offsets=True).withColumns(
        {"payload": text_payload("content"), "timestamp": F.lit("t"), "log_type": F.lit("text")}
    )
    folder = staging(i, "events")
    write_events(wrap_log_event(events, "now", collector_literal(queue="audit", hostname="host-1")), folder)
    event = F.from_json("value", "collector struct<hostname:string>, payload struct<message:string>")
    return i.spark.read.text(folder).select("queue", event.alias("e")).select(
        "queue", "e.payload.message", "e.collector.hostname"
    )


@query(
    "sink_metrics",
    _PER_NODE + "select 'node_stats' as name, node_id, 'folder' as sink from d union all select 'node_stats', node_id, 'function' from d",
)
def _(i: Inputs):
    events = m.node_event(m.prune_node(m.node_shard_summary(m.explode_nodes(node_docs(i)))))
    folder, table, made = staging(i, "metrics"), staging(i, "metric-table"), staging(i, "metric-events")
    # Two sinks take the events, so they are made once.
    with lean_writes(i.spark):
        events.write.option("compression", "zstd").parquet(made)
    events = i.spark.read.parquet(made)
    sink_metrics(events, folder, compression="gzip")
    label = "metadata.labels.node_id"
    sink_metrics(events, lambda df: df.select("metadata.name", label).write.parquet(table))
    written = F.from_json("value", "metadata struct<labels:map<string,string>>")["metadata"]["labels"]["node_id"]
    first = i.spark.read.text(folder).select("name", written.alias("node_id"), F.lit("folder").alias("sink"))
    return first.unionByName(i.spark.read.parquet(table).withColumn("sink", F.lit("function")))


@query("export_csv", cte("fx_listing") + "select path, size, inode from fx_listing")
def _(i: Inputs):
    folder = staging(i, "csv")
    export_csv(i.listing.select("path", "size", "inode"), folder)
    return i.spark.read.option("header", True).schema("path string, size bigint, inode bigint").csv(folder)
