"""Cluster metric documents into node, shard, index and cluster events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import OBJECT, as_text, put, remove_fields
from .envelope import labels, merge_labels, metric_event

Labels = Mapping[str, str] | None
UNSAFE_ID = "max_unsafe_auto_id_timestamp"
#: Shard copies by index; what is no list or no object is null.
COPIES = f"map<string,array<{OBJECT}>>"
#: Types that tell and count objects. Every variant taken out of another is built anew, a
#: member that is no boolean is just null.
KEYS = "map<string,boolean>"
COPY_KEYS = f"map<string,array<{KEYS}>>"


def _object(value: Column) -> Column:
    return value.try_cast(OBJECT)


def _is_object(value: Column) -> Column:
    return value.try_cast(KEYS).isNotNull()


def _count(obj: Column) -> Column:
    return F.when(obj.isNotNull(), F.size(obj))


def _keys(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


#: Columns that identify the cluster and the moment a document was taken.
SNAPSHOT = ("snapshot", "cluster_id", "cluster_uuid", "timestamp")


def explode_nodes(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per node of each document; nodes that are no objects are rejected."""
    nodes = F.try_variant_get(doc, "$.nodes", f"map<string,{OBJECT}>")
    rows = docs.select(*_keys(docs, SNAPSHOT), F.explode(nodes).alias("node_id", "node"))
    return rows.filter(F.col("node").isNotNull())


def explode_indices(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per index of index stats documents, and their ready-made ``_all``.

    ``primaries`` and ``total`` stay whole; a document without ``_all`` has no such row.
    """
    every = F.try_variant_get(doc, "$._all", "variant")
    named = F.map_filter(_object(F.try_variant_get(doc, "$.indices", "variant")), lambda k, _: k != "_all")
    found = F.coalesce(named, F.create_map().cast(OBJECT))
    found = F.when(every.isNotNull(), F.map_concat(found, F.create_map(F.lit("_all"), every))).otherwise(found)
    rows = docs.select(*_keys(docs, SNAPSHOT), F.explode(found).alias("index_name", "_stats"))
    stats = _object(F.col("_stats"))
    uuid = F.when(F.col("index_name") == "_all", F.lit("_all")).otherwise(as_text(stats["uuid"]))
    rows = rows.filter(stats.isNotNull())
    return rows.select(*_keys(rows, SNAPSHOT), "index_name", uuid.alias("index_uuid"), stats["primaries"].alias("primaries"), stats["total"].alias("total"))


def _explode_listing(docs: DataFrame, doc: str, fields: Mapping[str, str]) -> DataFrame:
    """Rows of documents that are lists of flat objects, with the named fields as text."""
    rows = docs.select(*_keys(docs, SNAPSHOT), F.explode(F.try_variant_get(doc, "$", "array<variant>")).alias("_row"))
    row = _object(F.col("_row"))
    rows = rows.filter(row.isNotNull())
    return rows.select(*_keys(rows, SNAPSHOT), *[as_text(row[source]).alias(name) for name, source in fields.items()])


def explode_shard_listing(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Shard listing documents as ``index_name, shard, shard_type, state, node_id``."""
    fields = {"index_name": "index", "shard": "shard", "shard_type": "prirep", "state": "state", "node_id": "id"}
    return _explode_listing(docs, doc, fields)


def explode_index_list(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Index list documents as ``index_name`` and what the list says about each."""
    fields = {"index_name": "index", "index_uuid": "uuid", "health": "health", "status": "status", "shards": "pri", "replicas": "rep", "docs_count": "docs.count"}
    return _explode_listing(docs, doc, fields)


def _shard_lists(node: Column, as_type: str) -> Column:
    return F.try_variant_get(node["indices"], "$.shards", as_type)


def explode_shards(nodes: DataFrame) -> DataFrame:
    """One row per shard copy of each node."""
    keep = [*_keys(nodes, SNAPSHOT), "node_id", "host"]
    rows = nodes.withColumn("host", as_text(F.col("node")["host"]))
    # Only the shards subtree goes through the explosions, not the whole node.
    rows = rows.select(*keep, F.explode(_shard_lists(F.col("node"), COPIES)).alias("index_name", "_list"))
    rows = rows.select(*keep, "index_name", F.explode("_list").alias("_copy"))
    return rows.select(*keep, "index_name", F.explode("_copy").alias("shard", "stats"))


def shard_event(shards: DataFrame, custom: Labels = None) -> DataFrame:
    """Shard copies as events; the unsafe id of their segments is emptied."""
    stats = _object(F.col("stats"))
    segments = F.try_variant_get("stats", "$.segments", OBJECT)
    cleared = F.to_variant_object(put(segments, UNSAFE_ID, F.parse_json(F.lit("null"))))
    has_segments = F.try_variant_get("stats", "$.segments", KEYS).isNotNull()
    body = F.when(has_segments, put(stats, "segments", cleared)).otherwise(stats)
    index_id = F.when(F.col("index_name") == "_all", F.lit("_all")).otherwise(
        F.concat_ws(":", F.coalesce("cluster_uuid", F.lit("")), "index_name")
    )
    computed = labels(
        {
            "cluster_id": F.col("cluster_id"),
            "node_id": F.col("node_id"),
            "index_name": F.col("index_name"),
            "index_id": index_id,
            "ip": F.col("host"),
            "shard": F.col("shard"),
            "shard_id": F.concat_ws(":", "node_id", "index_name", "shard"),
        },
        {"cluster_uuid": F.col("cluster_uuid")},
    )
    good = shards.filter(_is_object(F.col("stats")))
    return metric_event(good, "shard_stats", body, merge_labels(computed, custom), _time(good))


def _time(df: DataFrame) -> Column:
    return F.col("timestamp") if "timestamp" in df.columns else F.current_timestamp()


def node_shard_summary(nodes: DataFrame) -> DataFrame:
    """Index and shard counts per node, read from the document itself.

    No shuffle: the counts are sizes inside the node. Zeros when ``indices``
    has no shards, null when ``indices`` is missing.
    """
    node = F.col("node")
    lists = _shard_lists(node, COPY_KEYS)
    per_index = F.transform(
        F.map_values(lists),
        lambda v: F.coalesce(F.aggregate(v, F.lit(0), lambda a, copy: a + F.coalesce(_count(copy), F.lit(0))), F.lit(0)),
    )
    has_indices = _is_object(node["indices"])
    indices = F.coalesce(_count(lists), F.lit(0))
    shards = F.coalesce(F.aggregate(per_index, F.lit(0), lambda a, n: a + n), F.lit(0))
    return nodes.withColumns(
        {
            "indices_count": F.when(has_indices, indices).cast("bigint"),
            "shard_count": F.when(has_indices, shards).cast("bigint"),
        }
    )


def node_shards_from_listing(
    cat_shards: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ("node_id",)
) -> DataFrame:
    """Primaries, replicas, indices and the shard list per node of a listing.

    Unassigned copies are dropped. ``keys`` should name the listing too, so that
    a node's list stays that of one moment. Distinct indices are counted before
    the lists are built, on ``(keys, index)`` groups.
    """
    placed = cat_shards.filter(F.coalesce(F.col("state"), F.lit("")) != "UNASSIGNED")
    per_index = placed.groupBy(*keys, "index_name").agg(
        F.sum(F.when(F.col("shard_type") == "p", 1).otherwise(0)).alias("_p"),
        F.count(F.lit(1)).alias("_n"),
        F.collect_list(F.struct("index_name", "shard", "shard_type", "state")).alias("_list"),
    )
    out = per_index.groupBy(*keys).agg(
        F.sum("_p").cast("bigint").alias("shard_count"),
        F.sum(F.col("_n") - F.col("_p")).cast("bigint").alias("replicas_count"),
        F.count(F.lit(1)).cast("bigint").alias("indices_count"),
        F.array_sort(F.flatten(F.collect_list("_list"))).alias("shards"),
    )
    return nodes.join(out, list(keys), "left") if nodes is not None else out


def prune_node(nodes: DataFrame) -> DataFrame:
    """Drop the bulky parts of a node and add ``shard_info``."""
    counts = [c for c in ("indices_count", "shard_count", "replicas_count", "shards") if c in nodes.columns]
    # A node missing from a listing has no info at all, one without indices an empty one.
    absent = F.parse_json(F.lit("null" if "replicas_count" in counts else "{}"))
    info = F.when(F.col("indices_count").isNotNull(), F.to_variant_object(F.struct(*counts))).otherwise(absent)
    gone = ["adaptive_selection", "ingest", f"indices.segments.{UNSAFE_ID}", "indices.shards"]
    return nodes.withColumn("node", put(remove_fields("node", gone), "shard_info", info))


def node_event(nodes: DataFrame, custom: Labels = None) -> DataFrame:
    """Pruned nodes as events."""
    node = F.col("node")
    computed = labels(
        {
            "cluster_id": F.col("cluster_id"),
            "node_id": F.col("node_id"),
            "node_name": as_text(node["name"]),
            "ip": as_text(node["ip"]),
            "transport_address": as_text(node["transport_address"]),
        },
        {"cluster_uuid": F.col("cluster_uuid")},
    )
    return metric_event(nodes, "node_stats", node, merge_labels(computed, custom), _time(nodes))


def select_nodes(nodes: DataFrame, ids: Sequence[str] | DataFrame = ()) -> DataFrame:
    """The local node and those asked for by id; a long list comes as a table."""
    if isinstance(ids, DataFrame):
        wanted = ids.select("node_id").distinct().withColumn("_asked", F.lit(True))
        return nodes.join(wanted, "node_id", "left").filter(F.col("is_local") | F.col("_asked")).drop("_asked")
    asked = F.col("node_id").isin(list(ids)) if ids else F.lit(False)
    return nodes.filter(F.col("is_local") | asked)


def index_events(
    stats: DataFrame,
    cat_shards: DataFrame | None = None,
    indices: DataFrame | None = None,
    keys: Sequence[str] | None = None,
    available: bool = True,
) -> DataFrame:
    """Per index its stats, its info and its shard list; the last two may be absent.

    ``keys`` are the snapshot, where the stats have one, and the index: a list is then
    bounded to one moment.
    """
    keys = keys or [*_keys(stats, SNAPSHOT[:1]), "index_name"]
    out = stats
    if available and indices is not None:
        info = [c for c in indices.columns if c not in keys]
        join_on = [k for k in keys if k in indices.columns]
        out = out.join(indices.select(*join_on, F.struct(*info).alias("index_info")), join_on, "left")
    if available and cat_shards is not None:
        grouped = cat_shards.groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("shard", "shard_type", "state", "node_id"))).alias("shard_info")
        )
        out = out.join(grouped, list(keys), "left")
    return out


def all_index_row(stats: DataFrame, keys: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Add the ``_all`` row, summed from the indices; it has no info or shards."""
    totals = [F.sum(c).cast("bigint").alias(c) for c in sums]
    every = stats.groupBy(*keys).agg(*totals) if keys else stats.agg(*totals)
    every = every.withColumns({"index_name": F.lit("_all"), "index_uuid": F.lit("_all")})
    return stats.unionByName(every, allowMissingColumns=True)


def index_fields(events: DataFrame, primary_stats: bool = True, total_stats: bool | None = None) -> DataFrame:
    """Leave out what is switched off.

    ``total_stats`` follows ``primary_stats`` unless given; ``index_info`` and
    ``shard_info`` go with the primaries.
    """
    total_stats = primary_stats if total_stats is None else total_stats
    gone = [] if primary_stats else [c for c in events.columns if c.startswith("pri")] + ["index_info", "shard_info"]
    gone += [] if total_stats else [c for c in events.columns if c.startswith("total")]
    return events.drop(*gone)


def index_labels(custom: Labels = None) -> Column:
    """Labels of an index event; its id is built on the cluster's id, not its uuid."""
    index_id = F.when(F.col("index_uuid") == "_all", F.lit("_all")).otherwise(
        F.concat_ws(":", F.coalesce("cluster_id", F.lit("")), "index_name")
    )
    computed = labels(
        {
            "cluster_id": F.col("cluster_id"),
            "index_id": index_id,
            "index_uuid": F.col("index_uuid"),
            "index_name": F.col("index_name"),
        },
        {"cluster_uuid": F.col("cluster_uuid")},
    )
    return merge_labels(computed, custom)


def index_event(indices: DataFrame, body: Column, custom: Labels = None) -> DataFrame:
    return metric_event(indices, "index_stats", body, index_labels(custom), _time(indices))


def _cluster_event(docs: DataFrame, name: str, custom: Labels) -> DataFrame:
    computed = labels({"cluster_id": F.col("cluster_id"), "cluster_uuid": F.col("cluster_uuid")})
    return metric_event(docs, name, F.col("doc"), merge_labels(computed, custom), _time(docs))


def cluster_health_event(docs: DataFrame, custom: Labels = None) -> DataFrame:
    return _cluster_event(docs, "cluster_health", custom)


def cluster_stats_event(docs: DataFrame, custom: Labels = None) -> DataFrame:
    return _cluster_event(docs, "cluster_stats", custom)
