"""One function per collection job."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .functions.fields import parse_object, pick_text, remove_fields
from .functions.match import matches
from .functions.once import once
from .functions.timestamps import extract_timestamp
from .operators import metrics
from .operators.assemble import MAX_BYTES, assemble_joined
from .operators.envelope import object_literal, text_payload, wrap_log_event
from .operators.ordered import number_lines
from .operators.state import advance_state, classify_changes, load_state, save_state
from .session import checkpoint_dir
from .sinks import Sink, sink_metrics, write_events
from .sources.catalogue import LogPattern, pattern_index, route_files, search_log_patterns, usable
from .sources.listing import list_files
from .sources.ranges import OPEN_END, TOO_LONG, is_line, read_ranges, refused_lines, with_complete_end, with_identity
from .streaming.stateful import IDLE_SECONDS


def _by_pattern(patterns: Sequence[LogPattern], value) -> Column:
    """A column whose expression depends on the file's pattern."""
    index = F.col("pattern_index")
    first, *rest = list(enumerate(patterns))
    start = F.when(index == first[0], value(first[1]))
    return reduce(lambda chain, p: chain.when(index == p[0], value(p[1])), rest, start)


def _joins(pattern: LogPattern) -> Column:
    """Does a line continue the event before it?"""
    if pattern.type == "json":
        return ~matches("line", "^{")
    if pattern.type == "multiline" and pattern.line_pattern:
        return ~matches("line", pattern.line_pattern)
    return F.lit(False)


def _may_join(pattern: LogPattern) -> Column:
    """Can a line that is still to come belong to the file's last event?"""
    return F.lit(pattern.type == "json" or (pattern.type == "multiline" and bool(pattern.line_pattern)))


def log_events(
    lines: DataFrame,
    patterns: Sequence[LogPattern],
    now: Column | str,
    collector: Column | None = None,
    job_metadata: Mapping[str, object] | Column | DataFrame | None = None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """Lines of many files to events, each file by its own pattern, in one pass.

    JSON events that do not parse are left out; ``rejected_events`` has them.
    ``job_metadata`` may be a table of ``root, job_metadata``, one row per root.
    """
    return shape_events(assemble_logs(lines, patterns, max_bytes), patterns, now, collector, job_metadata)


def assemble_logs(lines: DataFrame, patterns: Sequence[LogPattern], max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Lines of many files to events, each file by its own pattern, as text."""
    wanted = usable(patterns)
    if "pattern_index" not in lines.columns:
        lines = lines.withColumn("pattern_index", pattern_index("path", wanted))
    # Columns of the file, the same on all its lines.
    kept = [F.any_value(c).alias(c) for c in ("pattern_index", "root") if c in lines.columns]
    return assemble_joined(lines, _by_pattern(wanted, _joins), max_bytes=max_bytes, aggregates=kept)


def rejected_events(events: DataFrame, patterns: Sequence[LogPattern]) -> DataFrame:
    """Assembled events of JSON logs that are no JSON object, and why."""
    is_json = _by_pattern(usable(patterns), lambda p: F.lit(p.type == "json"))
    bad = once(events.filter(is_json), "json", parse_object("content")).filter(F.col("json").isNull())
    return bad.select("path", "offset", "bytes", F.lit("no JSON object").alias("reason"), "content")


def shape_events(
    events: DataFrame,
    patterns: Sequence[LogPattern],
    now: Column | str,
    collector: Column | None = None,
    job_metadata: Mapping[str, object] | Column | DataFrame | None = None,
) -> DataFrame:
    """Assembled events to uniform rows."""
    wanted = usable(patterns)
    if isinstance(job_metadata, DataFrame):
        events = events.join(job_metadata.select("root", "job_metadata"), "root", "left")
        job_metadata = F.coalesce("job_metadata", object_literal(None))
    events = events.withColumn("log_type", _by_pattern(wanted, lambda p: F.lit(p.type)))
    is_json = F.col("log_type") == "json"
    events = once(events, "json", F.when(is_json, parse_object("content")))
    events = events.filter(~is_json | F.col("json").isNotNull())
    events = events.withColumns(
        {
            "timestamp": _by_pattern(
                wanted,
                lambda p: pick_text("json", p.timestamp_fields)
                if p.type == "json"
                else extract_timestamp("content", p.timestamp_patterns),
            ),
            "payload": _by_pattern(
                wanted, lambda p: remove_fields("json", p.remove_fields) if p.type == "json" else text_payload("content")
            ),
            "pattern_metadata": _by_pattern(wanted, lambda p: object_literal(p.metadata)),
        }
    )
    return wrap_log_event(events, now, collector, job_metadata, pattern_metadata="pattern_metadata")


def collect_logs(
    spark: SparkSession,
    roots: str | Sequence[str],
    patterns: Sequence[LogPattern],
    state_folder: str,
    output: str,
    now: str,
    collector: Column | None = None,
    job_metadata: Mapping[str, object] | DataFrame | None = None,
    max_bytes: int = MAX_BYTES,
    rejects: str | None = None,
    idle: float | None = None,
    pass_number: int | None = None,
) -> DataFrame:
    """One bounded pass over changed files; returns the changes it handled.

    Nothing vanishes: lines over four times ``max_bytes``, JSON events that do
    not parse and files that are gone or replaced when they are to be read go to
    ``pass=N`` of ``rejects`` (by default next to the output). Such a file does not stop
    the others; its state stays, so that a later pass takes it up.

    The changed files and their new lines are written once to the shared folder:
    later steps then see one state of files that keep growing, and a lost
    executor costs a re-read of that table only. Events go to ``pass=N`` before
    the state moves on; a pass that died is repeated into the same folder. A ``pass_number``
    says which pass this is, also where that one has been completed before: it starts from the
    state before it, and its events and state replace those it left.

    The last event of a file is taken as it stands. With ``idle`` it is left to a later pass, which
    reads it again, as long as the file was written to less than that many seconds before it was
    listed; an event over ``max_bytes`` is not waited for.
    """
    wanted = usable(patterns)
    staging = f"{checkpoint_dir(spark)}/pass-{uuid.uuid4().hex}"
    state = load_state(spark, state_folder, pass_number)
    listing = route_files(list_files(spark, roots), patterns, "name").select("path", "name", "size", "mtime", "inode", "root")
    if any("://" in root for root in ([roots] if isinstance(roots, str) else roots)):
        listing = with_identity(listing, state)
    changes = with_complete_end(classify_changes(listing, state).withColumn("pattern_index", pattern_index("name", wanted)))
    if idle is not None:
        fresh = F.col("mtime") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(idle)))
        changes = changes.withColumn("fresh", fresh & _by_pattern(wanted, _may_join) & ~F.col("path").endswith(".gz"))
    changes.write.parquet(f"{staging}/changes")
    changes = spark.read.parquet(f"{staging}/changes")
    if changes.isEmpty():
        return changes
    plan = changes.withColumnRenamed("complete_end", "end_offset")
    read_ranges(plan, carry=["pattern_index", "root", "inode"], limit=4 * max_bytes, reasons=True).write.parquet(f"{staging}/lines")
    rows = spark.read.parquet(f"{staging}/lines")
    # A file with a range that could not be read is left to the next pass as a whole.
    failed = rows.filter(~is_line(rows) & ~F.col("reason").isin(TOO_LONG, OPEN_END)).select("path").unionAll(
        changes.filter(F.col("complete_end").isNull()).select("path")
    ).distinct()
    changes = changes.join(failed, "path", "left_anti")
    taken = number_lines(rows.filter(is_line(rows)).join(failed, "path", "left_anti").drop("reason", "inode"), ["offset"])
    assemble_logs(taken, patterns, max_bytes).write.parquet(f"{staging}/events")
    assembled = spark.read.parquet(f"{staging}/events")
    if idle is not None:
        last = assembled.groupBy("path").agg(F.max_by(F.struct("offset", "bytes"), "offset").alias("_last"))
        held = changes.filter("fresh").join(last, "path").filter(F.col("_last.bytes") <= max_bytes)
        held = held.select("path", F.col("_last.offset").alias("offset"))
        assembled = assembled.join(held, ["path", "offset"], "left_anti")
    events = shape_events(assembled, patterns, now, collector, job_metadata)
    done = changes.withColumn("resume_offset", F.greatest("start_offset", "complete_end"))
    if "head" in done.columns:
        done = done.withColumn("inode", F.coalesce("head", "inode"))
    if idle is not None:
        # To the state such a file is one that ended, long ago, where the event begins.
        done = done.join(held.withColumnRenamed("offset", "_held"), "path", "left").withColumns(
            {
                "resume_offset": F.coalesce("_held", "resume_offset"),
                "size": F.coalesce("_held", "size"),
                "mtime": F.when(F.col("_held").isNull(), F.col("mtime")).otherwise(F.timestamp_micros(F.lit(0))),
            }
        )
    version = pass_number or _next_version(spark, state_folder)
    rejects = rejects or f"{output.rstrip('/')}-rejects"
    unread = F.lit(None).cast("string").alias("content")
    refused = rejected_events(assembled, patterns).unionByName(refused_lines(rows).select("*", unread))
    refused.write.mode("overwrite").parquet(f"{rejects}/pass={version}")
    write_events(events, f"{output}/pass={version}")
    save_state(advance_state(state, done), state_folder, version=version)
    return changes


def collect_stream(
    spark: SparkSession,
    roots: str | Sequence[str],
    patterns: Sequence[LogPattern],
    state_folder: str,
    output: str,
    collector: Column | None = None,
    job_metadata: Mapping[str, object] | DataFrame | None = None,
    max_bytes: int = MAX_BYTES,
    rejects: str | None = None,
    idle: float = IDLE_SECONDS,
) -> DataStreamWriter:
    """``collect_logs`` again and again, as a stream to be given a trigger, a checkpoint and a start.

    Batch N is pass N + 1: files are listed and compared with the state in tasks, each is read
    from where it was left, and its last event waits until the file has been quiet for ``idle``
    seconds. A batch that is repeated replaces its events and its state, so each event is there
    once. The state folder is the stream's own; it goes with its checkpoint.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def run(_: DataFrame, batch_id: int) -> None:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        collect_logs(
            spark, roots, patterns, state_folder, output, now, collector, job_metadata, max_bytes, rejects, idle, batch_id + 1
        )

    return clock.writeStream.foreachBatch(run)


def _next_version(spark: SparkSession, folder: str) -> int:
    from .operators.state import _versions

    versions = _versions(spark, folder)
    return (versions[-1] if versions else 0) + 1


def collect_search_logs(
    spark: SparkSession,
    jobs: DataFrame,
    state_folder: str,
    output: str,
    now: str,
    flags: Mapping[str, Mapping[str, bool]] | None = None,
    collector: Column | None = None,
) -> DataFrame:
    """Search nodes' logs: all directories of ``jobs_from_nodes`` in one pass.

    Every event carries the metadata of its directory's job. The few directories
    are listed by the driver; a job whose directory is missing is skipped. A
    directory named by several jobs belongs to the first node.
    """
    per_root = jobs.groupBy(F.col("logs_path").alias("root")).agg(F.min_by("metadata", "node_id").alias("job_metadata"))
    folders = sorted(r["root"] for r in per_root.select("root").toLocalIterator())
    present = [f for f in folders if _exists(spark, f)]
    if not present:
        raise FileNotFoundError("none of the jobs' log directories exists")
    return collect_logs(spark, present, search_log_patterns(flags), state_folder, output, now, collector, per_root)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def node_stats(
    docs: DataFrame,
    sink: Sink | str,
    level: str = "shards",
    cat_shards: DataFrame | None = None,
    labels: Mapping[str, str] | None = None,
) -> None:
    """Node and shard events of node stats documents."""
    nodes = metrics.explode_nodes(docs)
    if level == "shards":
        shards = metrics.shard_event(metrics.explode_shards(nodes), labels)
        summed = metrics.node_shard_summary(nodes)
        events = metrics.node_event(metrics.prune_node(summed), labels)
        sink_metrics(events.unionByName(shards), sink)
        return
    if cat_shards is None:
        raise ValueError("without the shards level a shard listing is needed")
    keys = [k for k in ("snapshot", "node_id") if k in cat_shards.columns and k in nodes.columns]
    counted = metrics.node_shards_from_listing(cat_shards, nodes, keys)
    sink_metrics(metrics.node_event(metrics.prune_node(counted), labels), sink)


def index_stats(
    stats: DataFrame,
    sink: Sink | str,
    cat_shards: DataFrame | None = None,
    indices: DataFrame | None = None,
    keys: Sequence[str] = ("index_name",),
    all_index_stats: bool = False,
    sums: Sequence[str] = (),
    labels: Mapping[str, str] | None = None,
    available: bool = True,
) -> None:
    """Index events with their info and shard lists, and the ``_all`` event."""
    events = metrics.index_events(stats, cat_shards, indices, keys, available)
    if all_index_stats:
        outer = [k for k in keys if k != "index_name"] + [
            c for c in ("cluster_id", "cluster_uuid", "timestamp") if c in stats.columns
        ]
        every = metrics.all_index_row(stats, outer, sums).filter(F.col("index_name") == "_all")
        events = events.unionByName(every, allowMissingColumns=True)
    plain = {*keys, "cluster_id", "cluster_uuid", "timestamp", "index_uuid"}
    body = F.struct(*[c for c in events.columns if c not in plain])
    sink_metrics(metrics.index_event(events, body, labels), sink)


def cluster_health(docs: DataFrame, sink: Sink | str, labels: Mapping[str, str] | None = None) -> None:
    sink_metrics(metrics.cluster_health_event(docs, labels), sink)


def cluster_stats(docs: DataFrame, sink: Sink | str, labels: Mapping[str, str] | None = None) -> None:
    sink_metrics(metrics.cluster_stats_event(docs, labels), sink)
