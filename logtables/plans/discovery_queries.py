"""Discovery and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery as d
from ..operators import serving as s
from ..operators.assemble import assemble
from ..sources.files import with_offsets
from ..sources.paths import safe_join
from .fixtures import Inputs, cte
from .registry import query
from .source_queries import staging

_ENGINES = f"regexp_matches(cmdline, '{d.ENGINE_CLASS}')"


@query("engine_processes", cte("fx_processes") + f"select host_id, pid, name from fx_processes where {_ENGINES}")
def _(i: Inputs):
    return d.filter_engine_processes(i.processes).select("host_id", "pid", "name")


# The socket table read back by SQL: fields of lines whose state listens.
_SOCKETS = r""", raw as (select host_id, seq, regexp_extract(line, '^\s*\d+:\s*(\S+)\s+\S+\s+(\S\S)\s+\S+\s+\S+\s+\S+\s+(\d+)', ['addr', 'st', 'uid']) as p from fx_sockets where line not like '%local_address%'),
 sk as (select host_id, seq, cast(p.uid as bigint) as uid, right(split_part(p.addr, ':', 1), 8) as h, cast('0x' || split_part(p.addr, ':', 2) as integer) as port from raw where p.st in ('0A', '06')),
 so as (select host_id, seq, uid, port, cast('0x' || h[7:8] as integer) || '.' || cast('0x' || h[5:6] as integer) || '.' || cast('0x' || h[3:4] as integer) || '.' || cast('0x' || h[1:2] as integer) as ip from sk)
"""


@query("parse_sockets", cte("fx_sockets") + _SOCKETS + "select host_id, seq, uid, ip, port from so")
def _(i: Inputs):
    return d.parse_sockets(i.sockets).select("host_id", "seq", "uid", "ip", "port")


# Connections: every third process listens itself, twice on the same address.
_CONNECTIONS = """select host_id, pid, k as seq, case when k = 2 then 'ESTABLISHED' else 'LISTEN' end as status,
 '127.0.0.' || cast(1 + pid % 3 as string) as ip, cast(9200 + (pid + case when k = 3 then 1 else 0 end) % 20 as int) as port"""


def _connections(i: Inputs) -> DataFrame:
    rows = i.processes.filter("pid % 3 = 0").select("host_id", "pid", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return rows.selectExpr(*[c.strip() for c in (
        "host_id", "pid", "k as seq", "case when k = 2 then 'ESTABLISHED' else 'LISTEN' end as status",
        "'127.0.0.' || cast(1 + pid % 3 as string) as ip",
        "cast(9200 + (pid + case when k = 3 then 1 else 0 end) % 20 as int) as port",
    )])


_ADDRESSES = (
    cte("fx_processes", "fx_sockets")
    + _SOCKETS
    + f""", ks as (select 0 as k union all select 1 union all select 2 union all select 3),
 conn as ({_CONNECTIONS} from fx_processes cross join ks where pid % 3 = 0),
 own as (select host_id, pid, ip, port, min(seq) as seq from conn where status = 'LISTEN' group by all),
 shared as (select p.host_id, p.pid, o.ip, o.port, min(o.seq) as seq from fx_processes p join so o on p.host_id = o.host_id and p.uid = o.uid
   where not exists (select 1 from own w where w.host_id = p.host_id and w.pid = p.pid) group by all),
 ad as (select * from own union all select * from shared)
"""
)


def _listening(i: Inputs) -> DataFrame:
    return d.attach_listen_addresses(i.processes, _connections(i), d.parse_sockets(i.sockets))


@query(
    "listen_addresses",
    _ADDRESSES
    + "select host_id, pid, string_agg(ip || ':' || port, ',' order by seq, ip, port) as addresses from ad group by all",
)
def _(i: Inputs):
    text = F.array_join(F.transform("addresses", lambda a: F.concat(a["ip"], F.lit(":"), a["port"].cast("string"))), ",")
    return _listening(i).select("host_id", "pid", text.alias("addresses"))


@query(
    "extract_paths",
    cte("fx_processes")
    + r"""select pid, 'spaced' as how, regexp_extract(cmdline, '-Des\.path\.home=(.*?)\s+', 1) as path_home, regexp_extract(cmdline, '-Des\.path\.conf=(.*?)\s+', 1) as path_conf from fx_processes
 union all select pid, 'quoted', replace(regexp_extract(cmdline, '-Des\.path\.home=(\S*)', 1), '"', ''), replace(regexp_extract(cmdline, '-Des\.path\.conf=(\S*)', 1), '"', '') from fx_processes""",
)
def _(i: Inputs):
    def run(quoted: bool, how: str) -> DataFrame:
        return d.extract_paths(i.processes, quoted).select("pid", F.lit(how).alias("how"), "path_home", "path_conf")

    return run(False, "spaced").unionByName(run(True, "quoted"))


# What answered at an address: nothing, a refusal, another node, or the node itself.
_ANSWER = "case pid % 4 when 0 then 'ok' when 1 then 'unauthorized' when 2 then 'closed' else 'ok' end"
_ANSWER_PID = "case when pid % 4 = 3 then pid + 1 else pid end"
_PROBES = f""", pr as (select host_id, ip, port, {_ANSWER.replace('pid', 'who')} as status, 'node-' || who as node_id, {_ANSWER_PID.replace('pid', 'who')} as node_pid,
   case when who % 4 in (1, 2) then '' else 'uuid' end as cluster_uuid from (select host_id, ip, port, min(pid) as who from ad group by all) t),
 pos as (select host_id, pid, ip, port, row_number() over (partition by host_id, pid order by seq, ip, port) as n from ad),
 hit as (select p.host_id, p.pid, n, r.ip, r.port, status, node_id, node_pid from pos p join pr r on p.host_id = r.host_id and p.ip = r.ip and p.port = r.port
   where status = 'unauthorized' or cluster_uuid <> ''),
 dec as (select * from (select *, row_number() over (partition by host_id, pid order by n) as r from hit) t where r = 1)
"""


def _probes(i: Inputs, listening: DataFrame) -> DataFrame:
    each = listening.select("host_id", "pid", F.explode("addresses").alias("a")).select("host_id", "pid", "a.ip", "a.port")
    who = each.groupBy("host_id", "ip", "port").agg(F.min("pid").alias("pid"))
    return who.selectExpr(
        "host_id", "ip", "port", f"{_ANSWER} as status", "'node-' || cast(pid as string) as node_id", f"{_ANSWER_PID} as node_pid",
        "case when pid % 4 in (1, 2) then '' else 'uuid' end as cluster_uuid",
    )


@query(
    "reconcile_nodes",
    _ADDRESSES + _PROBES + "select host_id, pid, ip, port, node_id from dec where status = 'ok' and node_pid = pid",
)
def _(i: Inputs):
    listening = _listening(i)
    return d.reconcile_nodes(listening, _probes(i, listening)).select("host_id", "pid", "ip", "port", "node_id")


@query(
    "unknown_processes",
    _ADDRESSES
    + _PROBES
    + """select host_id, pid from dec where status = 'unauthorized'""",
)
def _(i: Inputs):
    listening = _listening(i)
    return d.unknown_processes(listening, _probes(i, listening))


@query("filter_port", _ADDRESSES + "select host_id, pid, ip, port from ad where port = 9205")
def _(i: Inputs):
    each = _listening(i).select("host_id", "pid", F.explode("addresses").alias("a"))
    return d.filter_port(each.select("host_id", "pid", "a.ip", "a.port"), 9205)


_BOUND = """case o_orderkey % 4 when 0 then '10.0.0.' || cast(o_orderkey % 250 as string) || ':' || cast(9200 + o_orderkey % 50 as string)
 when 1 then '[fe80::' || cast(o_orderkey % 99 as string) || ']:9300' when 2 then 'localhost:' else 'no-port' end"""


@query(
    "bound_addresses",
    f"""with b as (select o_orderkey, {_BOUND} as address from orders)
select o_orderkey, regexp_extract(address, '^(.*):[^:]*$', 1) as ip, coalesce(try_cast(regexp_extract(address, '^.*:([^:]*)$', 1) as integer), 0) as port
from b where contains(address, ':')""",
)
def _(i: Inputs):
    df = i.table("orders").select("o_orderkey", F.expr(_BOUND).alias("address"))
    return d.parse_bound_addresses(df).select("o_orderkey", "ip", "port")


@query(
    "parse_node_info",
    cte("fx_nodes")
    + "select node_id, node_name, case when is_local then '7.10.2' else '1.0.' || length(host) end as version from fx_nodes",
)
def _(i: Inputs):
    version = F.when(F.col("is_local"), "7.10.2").otherwise(F.concat(F.lit("1.0."), F.length("host").cast("string")))
    node = F.struct(F.col("node_name").alias("name"), version.alias("version"))
    doc = F.parse_json(F.to_json(F.struct(F.create_map("node_id", node).alias("nodes"))))
    return d.parse_node_info(i.nodes.select(doc.alias("doc")))


@query(
    "endpoint_candidates",
    f"""with b as (select o_orderkey, {_BOUND} as address from orders),
 a as (select o_orderkey, regexp_extract(address, '^(.*):[^:]*$', 1) as ip, coalesce(try_cast(regexp_extract(address, '^.*:([^:]*)$', 1) as integer), 0) as port
   from b where contains(address, ':')),
 p as (select o_orderkey, trim(ip, '[]') as ip, port from a), k as (select 0 as attempt, 'http' as sch union all select 1, 'https')
select o_orderkey, attempt, sch || '://' || case when contains(ip, ':') then '[' || ip || ']' else ip end || ':' || port as url from p cross join k""",
)
def _(i: Inputs):
    df = d.parse_bound_addresses(i.table("orders").select("o_orderkey", F.expr(_BOUND).alias("address")))
    df = df.withColumn("ip", F.btrim("ip", F.lit("[]")))
    return d.endpoint_candidates(df).select("o_orderkey", "attempt", "url")


# ---- serving ----------------------------------------------------------------


@query(
    "list_log_files",
    """select source as folder, cast(sum(octet_length(encode(text)) + 1) as bigint) as size_in_bytes,
 cast(sum(len(string_split(text, chr(10)))) as bigint) as total_rows from documents group by source""",
)
def _(i: Inputs):
    # Real files, a folder per source; one folder asked for does not exist.
    docs = i.table("documents").select("source", F.col("text").alias("value"))
    folder = staging(i, "listed")
    docs.write.partitionBy("source").text(folder)
    asked = [f"{folder}/source={r.source}" for r in docs.select("source").distinct().collect()]
    files, errors = s.list_log_files(i.spark, [*asked, f"{folder}/none"])
    if len(errors) != 1:
        raise ValueError(f"one folder is missing, not {errors}")
    source = F.regexp_extract("logs_path", "source=([^/]*)$", 1).alias("folder")
    return files.groupBy(source).agg(F.sum("size_in_bytes").alias("size_in_bytes"), F.sum("total_rows").alias("total_rows"))


@query(
    "read_page",
    cte("fx_doc_lines")
    + """, o as (select path, line_no, line, octet_length(encode(line)) + 1 as bytes, sum(octet_length(encode(line)) + 1) over (partition by path order by line_no) as e from fx_doc_lines),
 q as (select doc_id as request_id, source || '/' || cast(doc_id as varchar) as path, doc_id % 4 - 1 as start_line, 3 + doc_id % 3 as n from documents),
 r as (select request_id, q.path, line_no, line, bytes, e, n from q join o on q.path = o.path where line_no >= greatest(start_line, 1) and line_no < greatest(start_line, 1) + n)
select request_id, path, line_no, line as content, bytes, cast(e as bigint) as end_offset, count(*) over (partition by request_id) < n as eof from r""",
)
def _(i: Inputs):
    lines = with_offsets(i.doc_lines).withColumn("bytes", (F.octet_length("line") + 1).cast("bigint"))
    requests = i.table("documents").select(
        F.col("doc_id").alias("request_id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        (F.col("doc_id") % 4 - 1).alias("start_line"),
        (3 + F.col("doc_id") % 3).alias("lines"),
    )
    return s.read_pages(lines, requests)


@query(
    "shape_line_numbers",
    cte("fx_text_lines")
    + """, e as (select *, sum(case when starts_with(line, '[') then 1 else 0 end) over (partition by path order by line_no) as ev from fx_text_lines)
select path, min(line_no) as line_from, case when count(*) = 1 then cast(min(line_no) as varchar) else '[' || string_agg(line_no, ',' order by line_no) || ']' end as line_numbers from e group by path, ev""",
)
def _(i: Inputs):
    events = assemble(i.text_lines, r"^\[").select(
        "path", F.col("line_from").cast("bigint").alias("line_from"), F.sequence("line_from", "line_to").alias("line_numbers")
    )
    return s.shape_line_numbers(events)


_NAMES = """case doc_id % 5 when 0 then 'server.log' when 1 then '../server.log' when 2 then 'a/../b.log' when 3 then '../base/' || cast(doc_id as string) else ' ' end"""


@query(
    "safe_join",
    f"""select doc_id, case doc_id % 5 when 0 then '/var/base/server.log' when 2 then '/var/base/b.log' when 3 then '/var/base/' || doc_id end as full_path from documents""",
)
def _(i: Inputs):
    df = i.table("documents").select("doc_id", F.lit(" /var//base/").alias("logs_path"), F.expr(_NAMES).alias("file_name"))
    return safe_join(df).select("doc_id", "full_path")


@query("filter_by_level", cte("fx_ev") + "select event_id, level from fx_ev where level in ('ERROR', 'WARN')")
def _(i: Inputs):
    return s.filter_by_level(i.ev, ["ERROR", "WARN"]).select("event_id", "level")


# The choice is by a Spark hash, so the SQL checks what any sample must satisfy.
@query(
    "sample_documents",
    "select lang, least(count(*), 7) as n, true as members from documents group by lang",
)
def _(i: Inputs):
    docs = i.table("documents").select("doc_id", "lang")
    picked = s.sample_documents(docs, 7, "doc_id", by="lang")
    checked = picked.join(docs.select("doc_id", F.col("lang").alias("l")), "doc_id", "left")
    return checked.groupBy("lang").agg(
        F.count_distinct("doc_id").alias("n"), F.coalesce(F.bool_and(F.col("l") == F.col("lang")), F.lit(False)).alias("members")
    )
