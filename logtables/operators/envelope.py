"""The uniform event row: collector, metadata, payload, timestamp; and its labels."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import OBJECT, put, update

COLLECTOR = "struct<queue:string,id:string,hostname:string,major_ip:string,ip:array<string>,tags:array<string>,labels:map<string,string>>"


def object_literal(values: Mapping[str, object] | None) -> Column:
    """A constant object as ``map<string,variant>``."""
    if not values:
        return F.create_map().cast(OBJECT)
    pairs: list[Column] = []
    for key, value in values.items():
        pairs += [F.lit(key), F.parse_json(F.lit(json.dumps(value)))]
    return F.create_map(*pairs)


def text_payload(message: Column | str) -> Column:
    """Payload of a text record: ``{message}``."""
    c = F.col(message) if isinstance(message, str) else message
    return F.create_map(F.lit("message"), c.cast("variant"))


def adapt_level(payload: Column | str) -> Column:
    """Rename the literal key ``log.level`` to ``level``, replacing one already there."""
    p = F.col(payload) if isinstance(payload, str) else payload
    renamed = put(F.map_filter(p, lambda k, v: k != "log.level"), "level", p["log.level"])
    return F.when(F.map_contains_key(p, "log.level"), renamed).otherwise(p)


def default_timestamp(extracted: Column | str, now: Column | str) -> Column:
    """The extracted text, else the collection time as RFC 3339."""
    c = F.col(extracted) if isinstance(extracted, str) else extracted
    clock = F.lit(now) if isinstance(now, str) else F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.coalesce(F.nullif(c, F.lit("")), clock)


def collector_literal(
    queue: str = "logs",
    id: str = "",
    hostname: str = "",
    major_ip: str = "",
    ip: Sequence[str] = (),
    tags: Sequence[str] = (),
    labels: Mapping[str, str] | None = None,
) -> Column:
    value = {"queue": queue, "id": id, "hostname": hostname, "major_ip": major_ip,
             "ip": list(ip), "tags": list(tags), "labels": dict(labels or {})}
    return F.from_json(F.lit(json.dumps(value)), COLLECTOR)


def wrap_log_event(
    events: DataFrame,
    now: Column | str,
    collector: Column | None = None,
    job_metadata: Mapping[str, object] | Column | None = None,
    log_type: Column | str = "log_type",
    pattern_metadata: Column | str | None = None,
) -> DataFrame:
    """``collector, metadata, payload, timestamp`` from path, end_offset, payload, timestamp.

    Metadata is the log type, then the job's, then the pattern's, then the file;
    later ones win key by key.
    """
    kind = F.col(log_type) if isinstance(log_type, str) else log_type
    job = job_metadata if isinstance(job_metadata, Column) else object_literal(job_metadata)
    extra = F.col(pattern_metadata) if isinstance(pattern_metadata, str) else pattern_metadata
    metadata = update(F.create_map(F.lit("log_type"), kind.cast("variant")), job)
    if extra is not None:
        metadata = update(metadata, F.coalesce(extra, F.create_map().cast(OBJECT)))
    where = F.struct(F.col("path").alias("path"), F.col("end_offset").alias("offset"))
    metadata = put(metadata, "file", F.to_variant_object(where))
    return events.select(
        "*",
        (collector if collector is not None else collector_literal()).alias("collector"),
        metadata.alias("metadata"),
        adapt_level("payload").alias("_payload"),
        default_timestamp("timestamp", now).alias("_timestamp"),
    ).select(
        "path",
        *[c for c in ("line_from", "offset", "end_offset") if c in events.columns],
        "collector",
        "metadata",
        F.col("_payload").alias("payload"),
        F.col("_timestamp").alias("timestamp"),
    )


def labels(required: Mapping[str, Column], optional: Mapping[str, Column] | None = None) -> Column:
    """Label map; an optional label is left out where it is empty."""
    pairs: list[Column] = []
    for key, value in {**required, **(optional or {})}.items():
        pairs += [F.lit(key), value.cast("string")]
    names = list(optional or {})
    return F.map_filter(
        F.create_map(*pairs), lambda k, v: ~k.isin(names) | (F.coalesce(v, F.lit("")) != "")
    ) if names else F.create_map(*pairs)


def merge_labels(base: Column | str, custom: Mapping[str, str] | Column | None) -> Column:
    """Custom labels replace computed ones."""
    b = F.col(base) if isinstance(base, str) else base
    if custom is None or (isinstance(custom, Mapping) and not custom):
        return b
    if not isinstance(custom, Column):
        pairs: list[Column] = []
        for key, value in custom.items():
            pairs += [F.lit(key), F.lit(str(value))]
        custom = F.create_map(*pairs)
    return update(b, custom)


def metric_event(
    df: DataFrame, name: str, body: Column, labels: Column, timestamp: Column | str, keep: Sequence[str] = ()
) -> DataFrame:
    """Snapshot event of the search category with its nested fields."""
    return df.select(
        *keep,
        F.struct(
            F.lit("elasticsearch").alias("category"),
            F.lit(name).alias("name"),
            F.lit("snapshot").alias("datatype"),
            labels.alias("labels"),
        ).alias("metadata"),
        F.to_variant_object(F.struct(F.struct(body.alias(name)).alias("elasticsearch"))).alias("fields"),
        (F.col(timestamp) if isinstance(timestamp, str) else timestamp).alias("timestamp"),
    )


def jobs_from_nodes(
    nodes: DataFrame,
    logs_paths: Sequence[str] | None = None,
    queue: str = "logs",
    metadata: Mapping[str, object] | None = None,
    custom_labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """One log job per node and directory.

    ``nodes`` has ``node_id, node_name, cluster_id, cluster_name, cluster_uuid,
    port`` and ``path_logs`` from the node's settings, which is the fallback when
    no directories are configured.
    """
    from ..sources.paths import normalise_path

    configured = list(logs_paths or ())
    raw = F.array(*[F.lit(p) for p in configured]) if configured else F.array("path_logs")
    base = labels(
        {
            "cluster_name": F.col("cluster_name"),
            "cluster_id": F.col("cluster_id"),
            "cluster_uuid": F.col("cluster_uuid"),
            "node_uuid": F.col("node_id"),
            "node_name": F.col("node_name"),
            "port": F.col("port"),
        }
    )
    job = F.create_map(
        F.lit("category"),
        F.lit("elasticsearch").cast("variant"),
        F.lit("labels"),
        F.to_variant_object(merge_labels(base, custom_labels)),
    )
    cleaned = F.array_distinct(
        F.filter(F.transform(raw, lambda p: normalise_path(p)), lambda p: p.isNotNull())
    )
    return nodes.select(
        "node_id",
        F.lit(queue).alias("queue"),
        update(job, object_literal(metadata)).alias("metadata"),
        F.explode(cleaned).alias("logs_path"),
    )
