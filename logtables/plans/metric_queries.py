"""Metric document queries.

Node stats documents are nested from ``lineitem``: one document per node and
listing, a listing being a run of a thousand orders, so a document keeps its
size however many rows a node has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import as_text, lookup
from ..operators import metrics as m
from .fixtures import Inputs, cte
from .registry import query

_OWN = {"owner": "test"}
#: A node's listings are dealt to so many shares, and each meets the node on its own.
SHARES = 16


def _snapshot_shards(i: Inputs) -> DataFrame:
    order = F.substring_index("shard", ".", 1).cast("bigint")
    return i.shard_rows.withColumn("snapshot", F.floor(order / 1000))


_SHARDS = ", sh as (select *, cast(split_part(shard, '.', 1) as bigint) // 1000 as snapshot, cast(substr(node_id, 2) as bigint) as no from fx_shard_rows)\n"
_NODE_NO = "cast(substr(node_id, 2) as bigint)"


def node_docs(i: Inputs, render: Callable[[Column], Column] = F.to_variant_object) -> DataFrame:
    """Node stats documents, one per (node, listing), as variants or what ``render`` makes of them.

    Every eleventh node has ``indices`` without shards, every thirteenth has no
    ``indices`` at all.
    """
    row = F.struct("index_name", "shard", "shard_type", "state", "docs", "size_in_bytes")
    # Plain rows are shuffled once, grouped, and meet their node where they are; documents, many times
    # larger, are built last. The nodes, a copy for each share, are the side that goes into memory.
    share = F.pmod(F.hash("snapshot"), F.lit(SHARES)).alias("share")
    rows = _snapshot_shards(i).select("snapshot", "node_id", share, row.alias("row")).repartition("node_id", "share")
    per_node = rows.groupBy("snapshot", "node_id", "share").agg(F.collect_list("row").alias("rows"))
    nodes = i.nodes.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).hint("shuffle_hash")

    def copy(r: Column) -> Column:
        stats = F.struct(
            F.struct(r["state"].alias("state"), (r["shard_type"] == "p").alias("primary")).alias("routing"),
            F.struct(r["docs"].alias("count")).alias("docs"),
            F.struct(r["size_in_bytes"].alias("size_in_bytes")).alias("store"),
            F.struct(F.lit(1).alias("count"), F.lit(-1).alias(m.UNSAFE_ID)).alias("segments"),
        )
        return F.create_map(r["shard"], stats)

    whole = lambda r: reduce(lambda a, b: a & b, [r[c].isNotNull() for c in ("shard", "shard_type", "state", "docs", "size_in_bytes")])
    names = F.array_distinct(F.filter(F.transform("rows", lambda r: r["index_name"]), lambda name: name.isNotNull()))
    copies = lambda name: F.transform(F.filter("rows", lambda r: (r["index_name"] == name) & whole(r)), copy)
    shards = F.map_from_entries(F.transform(names, lambda name: F.struct(name.alias("key"), copies(name).alias("value"))))
    docs = F.struct(F.lit(5).alias("count")).alias("docs")
    segments = F.struct(F.lit(2).alias("count"), F.lit(9).alias(m.UNSAFE_ID)).alias("segments")

    def body(*parts: Column) -> Column:
        node = F.struct(
            F.col("node_name").alias("name"), "host", F.col("host").alias("ip"),
            F.concat("host", F.lit(":9300")).alias("transport_address"),
            F.struct(F.lit(1).alias("x")).alias("adaptive_selection"), F.struct(F.lit(2).alias("y")).alias("ingest"),
            F.struct(F.lit(3).alias("mem")).alias("jvm"), *parts,
        )
        return render(F.struct(F.create_map("node_id", node).alias("nodes")))

    no = F.expr(_NODE_NO)
    doc = F.when(F.col("node_name").isNull() | F.col("host").isNull(), F.lit(None))
    doc = doc.when(no % 13 == 0, body()).when(no % 11 == 0, body(F.struct(docs, segments).alias("indices")))
    return per_node.join(nodes, ["node_id", "share"]).select(
        "snapshot",
        F.lit("cid").alias("cluster_id"),
        "cluster_uuid",
        F.lit("2025-01-01T00:00:00Z").alias("timestamp"),
        doc.otherwise(body(F.struct(docs, segments, shards.alias("shards")).alias("indices"))).alias("doc"),
    )


def _all_nodes(i: Inputs) -> DataFrame:
    return m.explode_nodes(node_docs(i))


def _label(*names: str) -> list[Column]:
    return [F.col("metadata.labels")[n].alias(n) for n in names]


_DOCS = cte("fx_shard_rows", "fx_nodes") + _SHARDS
_PER_NODE = (
    _DOCS
    + """, d as (select snapshot, s.node_id, s.no, any_value(n.node_name) as node_name, any_value(n.host) as host, any_value(n.cluster_uuid) as cluster_uuid,
   count(distinct index_name) as idx, count(*) as shards from sh s join fx_nodes n on s.node_id = n.node_id group by all)
"""
)


@query("explode_nodes", _PER_NODE + "select snapshot, node_id, node_name as name, cluster_uuid, no % 13 <> 0 as has_indices from d")
def _(i: Inputs):
    node = F.col("node")
    return _all_nodes(i).select(
        "snapshot", "node_id", as_text(node["name"]).alias("name"), "cluster_uuid",
        F.map_contains_key(node, "indices").alias("has_indices"),
    )


_SHARD_ROWS = """ from sh s join fx_nodes n on s.node_id = n.node_id where no % 11 <> 0 and no % 13 <> 0"""


@query("explode_shards", _DOCS + "select snapshot, s.node_id, host, index_name, shard, docs, state" + _SHARD_ROWS)
def _(i: Inputs):
    rows = m.explode_shards(_all_nodes(i))
    return rows.select(
        "snapshot", "node_id", "host", "index_name", "shard",
        F.try_variant_get("stats", "$.docs.count", "bigint").alias("docs"),
        F.try_variant_get("stats", "$.routing.state", "string").alias("state"),
    )


@query(
    "shard_event",
    _DOCS
    + """select snapshot || '' as stamp, s.node_id, index_name, cluster_uuid || ':' || index_name as index_id, host as ip, shard,
 s.node_id || ':' || index_name || ':' || shard as shard_id, nullif(cluster_uuid, '') as cluster_uuid, 'test' as owner,
 'shard_stats' as name, size_in_bytes, true as unsafe_emptied"""
    + _SHARD_ROWS,
)
def _(i: Inputs):
    shards = m.explode_shards(_all_nodes(i)).withColumn("timestamp", F.col("snapshot").cast("string"))
    events = m.shard_event(shards, _OWN)
    body = "$.elasticsearch.shard_stats"
    unsafe = F.try_variant_get("fields", f"{body}.segments.{m.UNSAFE_ID}", "variant")
    return events.select(
        F.col("timestamp").alias("stamp"),
        *_label("node_id", "index_name", "index_id", "ip", "shard", "shard_id", "cluster_uuid", "owner"),
        "metadata.name",
        F.try_variant_get("fields", f"{body}.store.size_in_bytes", "bigint").alias("size_in_bytes"),
        F.is_variant_null(unsafe).alias("unsafe_emptied"),
    )


_SUMMARY = """case when no % 13 = 0 then null when no % 11 = 0 then 0 else idx end as indices_count,
 case when no % 13 = 0 then null when no % 11 = 0 then 0 else shards end as shard_count"""


@query("node_shard_summary", _PER_NODE + f"select snapshot, node_id, {_SUMMARY} from d")
def _(i: Inputs):
    return m.node_shard_summary(_all_nodes(i)).select("snapshot", "node_id", "indices_count", "shard_count")


@query(
    "node_shards_listing",
    _DOCS
    + """, l as (select snapshot, node_id, count(*) filter (where shard_type = 'p') as shard_count, count(*) filter (where shard_type <> 'p') as replicas_count,
   count(distinct index_name) as indices_count, string_agg(index_name || '/' || shard, ',' order by index_name, shard, shard_type) as shards
 from sh where state <> 'UNASSIGNED' group by all),
 p as (select distinct snapshot, node_id from sh)
select p.snapshot, p.node_id, shard_count, replicas_count, indices_count, shards from p left join l on p.snapshot = l.snapshot and p.node_id = l.node_id""",
)
def _(i: Inputs):
    shards = _snapshot_shards(i)
    nodes = shards.select("snapshot", "node_id").distinct()
    out = m.node_shards_from_listing(shards, nodes, ("snapshot", "node_id"))
    text = F.array_join(F.transform("shards", lambda s: F.concat(s["index_name"], F.lit("/"), s["shard"])), ",")
    return out.withColumn("shards", text)


@query(
    "prune_node",
    _PER_NODE
    + f"""select snapshot, node_id, no % 13 <> 0 as has_segments, false as has_unsafe, false as has_shards,
 case when no % 13 = 0 then '["host","ip","jvm","name","shard_info","transport_address"]' else '["host","indices","ip","jvm","name","shard_info","transport_address"]' end as keys,
 {_SUMMARY} from d""",
)
def _(i: Inputs):
    nodes = m.prune_node(m.node_shard_summary(_all_nodes(i)))
    info = F.col("node")["shard_info"]
    return nodes.select(
        "snapshot", "node_id",
        lookup("node", "indices.segments.count").isNotNull().alias("has_segments"),
        lookup("node", f"indices.segments.{m.UNSAFE_ID}").isNotNull().alias("has_unsafe"),
        lookup("node", "indices.shards").isNotNull().alias("has_shards"),
        F.to_json(F.array_sort(F.map_keys("node"))).alias("keys"),
        F.try_variant_get(info, "$.indices_count", "bigint").alias("indices_count"),
        F.try_variant_get(info, "$.shard_count", "bigint").alias("shard_count"),
    )


@query(
    "node_event",
    _PER_NODE
    + """select node_id, 'cid' as cluster_id, node_name, host as ip, host || ':9300' as transport_address, nullif(cluster_uuid, '') as cluster_uuid,
 cast(null as varchar) as owner, 'elasticsearch' as category, 'snapshot' as datatype, 3 as jvm from d""",
)
def _(i: Inputs):
    events = m.node_event(m.prune_node(m.node_shard_summary(_all_nodes(i))))
    return events.select(
        *_label("node_id", "cluster_id", "node_name", "ip", "transport_address", "cluster_uuid", "owner"),
        "metadata.category", "metadata.datatype",
        F.try_variant_get("fields", "$.elasticsearch.node_stats.jvm.mem", "int").alias("jvm"),
    )


@query(
    "select_nodes",
    cte("fx_nodes") + "select node_id, 'list' as how from fx_nodes where is_local or node_id in ('n1', 'n4')"
    " union all select node_id, 'table' from fx_nodes where is_local or cluster_uuid = ''",
)
def _(i: Inputs):
    few = m.select_nodes(i.nodes, ["n1", "n4"]).select("node_id", F.lit("list").alias("how"))
    many = m.select_nodes(i.nodes, i.nodes.filter("cluster_uuid = ''").select("node_id"))
    return few.unionByName(many.select("node_id", F.lit("table").alias("how")))


_INDEX = (
    _DOCS
    + """, st as (select snapshot, index_name, 'u-' || index_name as index_uuid, cast(sum(docs) as bigint) as total_docs,
   cast(sum(size_in_bytes) as bigint) as total_bytes, cast(sum(case when shard_type = 'p' then docs else 0 end) as bigint) as pri_docs from sh group by all),
 inf as (select snapshot, index_name, case when total_docs % 2 = 0 then 'green' else 'yellow' end as health from st where index_name not in ('idx-3', 'idx-7')),
 li as (select snapshot, index_name, string_agg(shard, ',' order by shard, shard_type, state, node_id) as shards from sh where index_name <> 'idx-9' group by all)
"""
)


def _index_stats(i: Inputs) -> DataFrame:
    return _snapshot_shards(i).groupBy("snapshot", "index_name").agg(
        F.sum("docs").cast("bigint").alias("total_docs"),
        F.sum("size_in_bytes").cast("bigint").alias("total_bytes"),
        F.sum(F.when(F.col("shard_type") == "p", F.col("docs")).otherwise(0)).cast("bigint").alias("pri_docs"),
    ).withColumn("index_uuid", F.concat(F.lit("u-"), "index_name"))


def _index_events(i: Inputs, **options) -> DataFrame:
    stats = _index_stats(i)
    info = stats.filter(~F.col("index_name").isin("idx-3", "idx-7")).select(
        "snapshot", "index_name", F.when(F.col("total_docs") % 2 == 0, "green").otherwise("yellow").alias("health")
    )
    shards = _snapshot_shards(i).filter(F.col("index_name") != "idx-9")
    return m.index_events(stats, shards, info, ("snapshot", "index_name"), **options)


@query(
    "index_events",
    _INDEX
    + """select st.snapshot, st.index_name, index_uuid, total_docs, total_bytes, pri_docs, health, shards, true as available from st
 left join inf on st.snapshot = inf.snapshot and st.index_name = inf.index_name left join li on st.snapshot = li.snapshot and st.index_name = li.index_name
 union all select snapshot, index_name, index_uuid, total_docs, total_bytes, pri_docs, null, null, false from st""",
)
def _(i: Inputs):
    up = _index_events(i).withColumns(
        {
            "health": F.col("index_info.health"),
            "shards": F.array_join(F.transform("shard_info", lambda s: s["shard"]), ","),
            "available": F.lit(True),
        }
    ).drop("index_info", "shard_info")
    down = _index_events(i, available=False).withColumn("available", F.lit(False))
    return up.unionByName(down, allowMissingColumns=True)


@query(
    "all_index_event",
    _INDEX
    + """select snapshot, index_name, index_uuid, total_docs, total_bytes, pri_docs from st union all
 select snapshot, '_all', '_all', cast(sum(total_docs) as bigint), cast(sum(total_bytes) as bigint), cast(sum(pri_docs) as bigint) from st group by snapshot""",
)
def _(i: Inputs):
    return m.all_index_row(_index_stats(i), ("snapshot",), ("total_docs", "total_bytes", "pri_docs"))


@query(
    "index_fields",
    _INDEX
    + """, a as (select st.*, health is not null as info from st left join inf on st.snapshot = inf.snapshot and st.index_name = inf.index_name)
select snapshot, index_name, total_docs, pri_docs, info, 'both' as shown from a union all select snapshot, index_name, null, null, null, 'neither' from a
 union all select snapshot, index_name, total_docs, null, null, 'total' from a""",
)
def _(i: Inputs):
    base = _index_events(i)

    def shown(name: str, **toggles) -> DataFrame:
        df = m.index_fields(base, **toggles)
        if "index_info" in df.columns:
            df = df.withColumn("info", F.col("index_info").isNotNull())
        keep = [c for c in ("snapshot", "index_name", "total_docs", "pri_docs", "info") if c in df.columns]
        return df.select(*keep, F.lit(name).alias("shown"))

    parts = [shown("both"), shown("neither", primary_stats=False), shown("total", primary_stats=False, total_stats=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query(
    "index_labels",
    _INDEX
    + """, a as (select snapshot, index_name, index_uuid, total_docs from st union all select snapshot, '_all', '_all', cast(sum(total_docs) as bigint) from st group by snapshot)
select snapshot, index_name, index_uuid, case when index_uuid = '_all' then '_all' else 'cid:' || index_name end as index_id, 'test' as owner, 'index_stats' as name, total_docs from a""",
)
def _(i: Inputs):
    stats = m.all_index_row(_index_stats(i), ("snapshot",), ("total_docs", "total_bytes", "pri_docs"))
    stats = stats.withColumns({"cluster_id": F.lit("cid"), "cluster_uuid": F.lit("u"), "timestamp": F.col("snapshot")})
    events = m.index_event(stats, F.struct(F.struct(F.col("total_docs").alias("docs")).alias("total")), _OWN)
    return events.select(
        F.col("timestamp").alias("snapshot"), *_label("index_name", "index_uuid", "index_id", "owner"), "metadata.name",
        F.try_variant_get("fields", "$.elasticsearch.index_stats.total.docs", "bigint").alias("total_docs"),
    )


@query(
    "metric_event",
    cte("fx_nodes")
    + """select node_id, 'elasticsearch' as category, 'probe' as name, 'snapshot' as datatype, host, 't0' as timestamp from fx_nodes""",
)
def _(i: Inputs):
    from ..operators.envelope import labels, metric_event

    df = metric_event(
        i.nodes, "probe", F.struct("host"), labels({"node_id": F.col("node_id")}), F.lit("t0"), keep=["node_id"]
    )
    return df.select(
        "node_id", "metadata.category", "metadata.name", "metadata.datatype",
        F.try_variant_get("fields", "$.elasticsearch.probe.host", "string").alias("host"), "timestamp",
    )


def _cluster_docs(i: Inputs) -> DataFrame:
    """One health-like document per listing."""
    per = _snapshot_shards(i).groupBy("snapshot").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("state") == "UNASSIGNED", 1).otherwise(0)).alias("u")
    )
    doc = F.to_variant_object(
        F.struct(
            F.when(F.col("u") > 0, "yellow").otherwise("green").alias("status"),
            F.col("n").alias("active_shards"),
            F.struct(F.col("u").alias("unassigned")).alias("shards"),
        )
    )
    return per.select(
        F.lit("cid").alias("cluster_id"),
        F.when(F.col("snapshot") % 2 == 0, "").otherwise("uuid").alias("cluster_uuid"),
        F.col("snapshot").alias("timestamp"),
        doc.alias("doc"),
    )


def _cluster_sql(name: str) -> str:
    return (
        _DOCS
        + f"""select snapshot, 'cid' as cluster_id, case when snapshot % 2 = 0 then '' else 'uuid' end as cluster_uuid, 'test' as owner, '{name}' as name,
 case when count(*) filter (where state = 'UNASSIGNED') > 0 then 'yellow' else 'green' end as status, count(*) as active_shards,
 count(*) filter (where state = 'UNASSIGNED') as unassigned from sh group by snapshot"""
    )


def _cluster(events: DataFrame, name: str) -> DataFrame:
    body = f"$.elasticsearch.{name}"
    return events.select(
        F.col("timestamp").alias("snapshot"), *_label("cluster_id", "cluster_uuid", "owner"), "metadata.name",
        F.try_variant_get("fields", f"{body}.status", "string").alias("status"),
        F.try_variant_get("fields", f"{body}.active_shards", "bigint").alias("active_shards"),
        F.try_variant_get("fields", f"{body}.shards.unassigned", "bigint").alias("unassigned"),
    )


@query("cluster_health_event", _cluster_sql("cluster_health"))
def _(i: Inputs):
    return _cluster(m.cluster_health_event(_cluster_docs(i), _OWN), "cluster_health")


@query("cluster_stats_event", _cluster_sql("cluster_stats"))
def _(i: Inputs):
    return _cluster(m.cluster_stats_event(_cluster_docs(i), _OWN), "cluster_stats")
