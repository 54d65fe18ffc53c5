"""Operator inputs derived from the provided tables.

Each input exists twice: as a DataFrame (``Inputs``) and as a DuckDB common
table expression (``cte``), row for row the same.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import number_lines

_EV = """
 event_id, ts, user_id, event_type, props,
 cast(round(value * 100) as bigint) as cents,
 'node-' || cast(user_id % 8 as string) as node,
 cast(year(ts) as string) || '-' || lpad(cast(month(ts) as string), 2, '0') || '-' || lpad(cast(day(ts) as string), 2, '0')
   || 'T' || lpad(cast(hour(ts) as string), 2, '0') || ':' || lpad(cast(minute(ts) as string), 2, '0') || ':' || lpad(cast(second(ts) as string), 2, '0') as sec_text,
 lpad(cast(event_id % 1000 as string), 3, '0') as ms,
 case event_type when 'error' then 'ERROR' when 'signup' then 'WARN' when 'purchase' then 'INFO' else 'DEBUG' end as level
"""
_TEXT_LINE = """case when k = 0 then '[' || sec_text || ',' || ms || '][' || level || '][' || event_type || '] user=' || cast(user_id as string) || ' cents=' || cast(cents as string)
 when event_type = 'error' then '  at frame.' || cast(k as string) else 'END' end"""
_TEXT_KEEP = "k = 0 or event_type = 'error' or (event_type = 'purchase' and k = 1)"
_JSON_LINE = """case when k = 1 then '"message":"user ' || cast(user_id as string) || '","cents":' || cast(cents as string) || '}'
 else '{"type":"server","timestamp":"' || sec_text || '.' || ms || 'Z","log.level":"' || level || '","cluster.name":"c1","node":{"name":"' || node || '","id":"' || cast(user_id as string) || '"},"props":' || props || ','
   || case when event_id % 10 = 0 then ''
           when event_id % 97 = 0 then '"message":'
           else '"message":"user ' || cast(user_id as string) || '","cents":' || cast(cents as string) || '}' end end"""
_JSON_KEEP = "k = 0 or event_id % 10 = 0"
_STREAM = "case when user_id % 2 = 0 then 'stdout' else 'stderr' end"
_CRI_LINE = f"""sec_text || '.' || ms || 'Z ' || {_STREAM}
 || case when event_id % 5 in (1, 2) then ' P ' else ' F ' end || event_type || ' ' || cast(cents as string)"""
_DOCKER_LINE = f"""'{{"log":"' || event_type || ' ' || cast(cents as string) || case when event_id % 5 in (1, 2) then '' else chr(92) || 'n' end
 || '","stream":"' || {_STREAM} || '","attrs":{{"k":"' || cast(user_id as string) || '"}},"time":"' || sec_text || '.' || ms || 'Z"}}'"""
_LISTING = """'d' || cast(o_custkey % 10 as string) || '/' || cast(o_orderkey as string)
 || case o_orderkey % 7 when 0 then '_server.json' when 1 then '_audit.json' when 2 then '_deprecation.json' when 3 then '-gc.log'
      when 4 then '_index_search_slowlog.json' when 5 then '.log' else '.txt' end as path,
 cast(round(o_totalprice) as bigint) as size, o_orderdate as mtime, o_orderkey as inode,
 case when o_orderkey % 50 = 0 then 'd0/' || cast(o_orderkey - 1 as string) || '.real' else null end as link_target"""
_STATE = """path,
 case inode % 5 when 1 then size - 10 when 2 then size + 10 else size end as size,
 case when inode % 5 = 0 then mtime else mtime - interval 1 day end as mtime,
 case when inode % 11 = 0 then inode + 1 else inode end as inode,
 case inode % 5 when 1 then size - 10 when 2 then size + 10 else size end as resume_offset"""
_NODES = """'n' || cast(s_suppkey as string) as node_id, s_name as node_name, '10.0.' || cast(s_nationkey as string) || '.' || cast(s_suppkey % 250 as string) as host,
 s_suppkey % 3 = 0 as is_local, case when s_suppkey % 4 = 0 then '' else 'uuid-' || cast(s_nationkey % 5 as string) end as cluster_uuid"""
_SHARDS = """'n' || cast(l_suppkey as string) as node_id, 'idx-' || cast(l_partkey % 40 as string) as index_name,
 cast(l_orderkey as string) || '.' || cast(l_linenumber as string) as shard,
 case when l_returnflag = 'N' then 'p' else 'r' end as shard_type,
 case when l_linestatus = 'O' and l_linenumber = 1 then 'UNASSIGNED' else 'STARTED' end as state,
 cast(round(l_quantity) as bigint) as docs, cast(round(l_extendedprice) as bigint) as size_in_bytes"""
_INDEX_STATS = """index_name, 'u-' || index_name as index_uuid, sum(docs) as total_docs, sum(size_in_bytes) as total_bytes,
 sum(case when shard_type = 'p' then docs else 0 end) as pri_docs"""
_INDICES = "index_name, case when total_docs % 2 = 0 then 'green' else 'yellow' end as health, 'open' as status"
_INDICES_KEEP = "index_name not in ('idx-3', 'idx-7')"
_PROCESSES = """c_nationkey as host_id, c_custkey as pid, c_custkey % 40 as uid, c_name as name,
 case c_mktsegment when 'BUILDING' then '/bin/java -Des.path.home=/opt/a' || cast(c_custkey as string) || ' -Des.path.conf=/etc/a -cp x org.elasticsearch.bootstrap.Elasticsearch'
      when 'MACHINERY' then '/bin/java -Des.path.home=/opt/b -Des.path.conf="/etc/b" -cp x org.opensearch.bootstrap.OpenSearch -d'
      when 'AUTOMOBILE' then '/bin/java -cp x ORG.OPENSEARCH.bootstrap.OpenSearch'
      else '/usr/bin/python app.py' end as cmdline"""
_SOCKETS = """o_custkey % 25 as host_id, o_orderkey as seq,
 case when o_orderkey % 100 = 0 then '  sl  local_address rem_address   st tx_queue rx_queue tr tm->when retrnsmt   uid  timeout inode'
      else cast(o_orderkey as string) || ': ' || case when o_orderkey % 9 = 0 then '0000000000000000FFFF0000' else '' end
        || '0' || cast(o_orderkey % 10 as string) || '00007F:' || lpad(hex(9200 + o_orderkey % 20), 4, '0') || ' 00000000:0000 '
        || case o_orderkey % 4 when 0 then '0A' when 1 then '06' else '01' end || ' 00000000:00000000 00:00000000 00000000 ' || cast(o_custkey % 40 as string) || ' 0 ' || cast(o_orderkey as string) end as line"""

# The request paths of FIXTURES.md, spread over every customer.
_PATHS = [
    (0, "' /var/log/es/' || cast(c_nationkey as string)"),
    (1, "'/var/log/es/gc'"),
    (2, "'/var/log/es/' || cast(c_nationkey as string) || '/'"),
    (3, "''"),
    (4, "'/a/b/../c//d' || cast(c_custkey % 7 as string) || '/.'"),
    (5, "'C:/logs/' || cast(c_custkey as string)"),
]


def _numbered(body: str, keep: str, ks: int, path: str) -> str:
    k_rows = " union all ".join(f"select {k} as k" for k in range(ks))
    return (
        f"select {path} as path, row_number() over (partition by node order by ts, event_id, k) as line_no, "
        f"event_id, k, {body} as line from fx_ev cross join ({k_rows}) n where {keep}"
    )


_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_ev": (f"select {_EV} from events", ()),
    "fx_text_lines": (_numbered(_TEXT_LINE, _TEXT_KEEP, 3, "node || '.log'"), ("fx_ev",)),
    "fx_json_lines": (_numbered(_JSON_LINE, _JSON_KEEP, 2, "node || '_server.json'"), ("fx_ev",)),
    "fx_cri_lines": (_numbered(_CRI_LINE, "true", 1, "node"), ("fx_ev",)),
    "fx_docker_lines": (_numbered(_DOCKER_LINE, "true", 1, "node"), ("fx_ev",)),
    "fx_doc_lines": (
        "select source || '/' || cast(doc_id as string) as path, "
        "cast(generate_subscripts(string_split(text, chr(10)), 1) as bigint) as line_no, "
        "unnest(string_split(text, chr(10))) as line from documents",
        (),
    ),
    "fx_listing": (f"select {_LISTING} from orders", ()),
    "fx_state": (f"select {_STATE} from fx_listing where inode % 3 <> 0", ("fx_listing",)),
    "fx_nodes": (f"select {_NODES} from supplier", ()),
    "fx_shard_rows": (f"select {_SHARDS} from lineitem", ()),
    "fx_index_stats": (f"select {_INDEX_STATS} from fx_shard_rows group by index_name", ("fx_shard_rows",)),
    "fx_indices": (f"select {_INDICES} from fx_index_stats where {_INDICES_KEEP}", ("fx_index_stats",)),
    "fx_processes": (f"select {_PROCESSES} from customer", ()),
    "fx_sockets": (f"select {_SOCKETS} from orders", ()),
    "fx_paths": (
        " union all ".join(f"select c_custkey as job, {pos} as pos, {raw} as raw from customer" for pos, raw in _PATHS),
        (),
    ),
}


def cte(*names: str) -> str:
    """``with ...`` text that defines the named inputs and what they build on."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for base in _CTES[name][1]:
            need(base)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    return "with " + ",\n".join(f"{n} as ({_CTES[n][0]})" for n in ordered) + "\n"


class Inputs:
    """The same inputs as DataFrames over the parquet tables of ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        return self.table("events").selectExpr(*_split_columns(_EV))

    def _lines(self, body: str, keep: str, ks: int, path: str) -> DataFrame:
        rows = self.ev.select(
            F.expr(path).alias("path"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("chunk"),
            "*",
            F.explode(F.array(*[F.lit(k) for k in range(ks)])).alias("k") if ks > 1 else F.lit(0).alias("k"),
        ).filter(keep)
        rows = rows.select("path", "chunk", "ts", "event_id", "k", F.expr(body).alias("line"))
        return number_lines(rows, ["ts", "event_id", "k"]).select("path", "chunk", "line_no", "event_id", "k", "line")

    @cached_property
    def text_lines(self) -> DataFrame:
        return self._lines(_TEXT_LINE, _TEXT_KEEP, 3, "node || '.log'").drop("event_id", "k")

    @cached_property
    def json_lines(self) -> DataFrame:
        return self._lines(_JSON_LINE, _JSON_KEEP, 2, "node || '_server.json'")

    @cached_property
    def cri_lines(self) -> DataFrame:
        return self._lines(_CRI_LINE, "true", 1, "node").drop("event_id", "k")

    @cached_property
    def docker_lines(self) -> DataFrame:
        return self._lines(_DOCKER_LINE, "true", 1, "node").drop("event_id", "k")

    @cached_property
    def doc_lines(self) -> DataFrame:
        return (
            self.table("documents")
            .select(
                F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
                F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"),
            )
            .select("path", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
        )

    @cached_property
    def listing(self) -> DataFrame:
        return self.table("orders").selectExpr(*_split_columns(_LISTING))

    @cached_property
    def state(self) -> DataFrame:
        return self.listing.filter("inode % 3 <> 0").selectExpr(*_split_columns(_STATE))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("supplier").selectExpr(*_split_columns(_NODES))

    @cached_property
    def shard_rows(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*_split_columns(_SHARDS))

    @cached_property
    def index_stats(self) -> DataFrame:
        return self.shard_rows.groupBy("index_name").agg(
            F.sum("docs").alias("total_docs"),
            F.sum("size_in_bytes").alias("total_bytes"),
            F.sum(F.when(F.col("shard_type") == "p", F.col("docs")).otherwise(0)).alias("pri_docs"),
        ).withColumn("index_uuid", F.concat(F.lit("u-"), "index_name"))

    @cached_property
    def indices(self) -> DataFrame:
        return self.index_stats.filter(_INDICES_KEEP).selectExpr(*_split_columns(_INDICES))

    @cached_property
    def processes(self) -> DataFrame:
        return self.table("customer").selectExpr(*_split_columns(_PROCESSES))

    @cached_property
    def sockets(self) -> DataFrame:
        return self.table("orders").selectExpr(*_split_columns(_SOCKETS))

    @cached_property
    def paths(self) -> DataFrame:
        items = F.array(*[F.struct(F.lit(p).alias("pos"), F.expr(raw).alias("raw")) for p, raw in _PATHS])
        return self.table("customer").select(F.col("c_custkey").alias("job"), F.explode(items).alias("i")).select(
            "job", "i.pos", "i.raw"
        )


def _split_columns(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted and c == "(":
            depth += 1
        elif not quoted and c == ")":
            depth -= 1
        elif not quoted and depth == 0 and c == ",":
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]
