"""File, path, state and envelope queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import as_text, lookup, put
from ..functions.timestamps import SEARCH_LOG_TIMESTAMPS, extract_timestamp
from ..operators.assemble import assemble
from ..operators.envelope import (
    adapt_level,
    collector_literal,
    default_timestamp,
    jobs_from_nodes,
    merge_labels,
    text_payload,
    wrap_log_event,
)
from ..operators.jsonlog import accepted, read_json_events
from ..operators.state import advance_state, classify_changes, resolve_links
from ..session import checkpoint_dir
from ..sources.catalogue import LogPattern, route_files, search_log_patterns
from ..sources.files import (
    decode_lines,
    drop_overlong_lines,
    position_lines,
    scan_lines,
    split_lines,
    strip_newline,
    trim_bom,
    with_line_numbers,
    with_offsets,
)
from ..sources.paths import normalise_paths
from .fixtures import Inputs, cte
from .registry import query


def staging(i: Inputs, what: str) -> str:
    """A fresh folder for files that a query writes and reads back."""
    return f"{checkpoint_dir(i.spark)}/{what}-{uuid.uuid4().hex}"


def write_logs(i: Inputs, lines: DataFrame, folder: str, text: str, compression: str = "none") -> None:
    """Lines as text files: a contiguous piece of the log per task.

    Pieces are cut by range of (path, chunk), so a hot log becomes many files.
    """
    pieces = lines.repartitionByRange("path", "chunk").sortWithinPartitions("path", "chunk", "line_no")
    pieces.select(F.expr(text).alias("value")).write.option("compression", compression).text(folder)


_TAGGED = "concat_ws('\t', path, cast(line_no as string), line)"


def _read_back(i: Inputs, folder: str, **position) -> DataFrame:
    """Scanned lines next to what was written, with an order check per file."""
    rows = position_lines(scan_lines(i.spark, folder), **position)
    part = F.split("line", "\t", 3)
    rows = rows.select(
        F.col("path").alias("file"),
        F.col("line_no").alias("n"),
        part[0].alias("path"),
        part[1].cast("bigint").alias("line_no"),
        part[2].alias("line"),
    )
    # In a file the written numbers run in step with the scanned ones.
    step = F.min(F.col("line_no") - F.col("n")).over(Window.partitionBy("file", "path"))
    in_order = (F.col("line_no") - F.col("n")) == step
    return rows.select("path", "line_no", "line", in_order.alias("in_order"))


_WRITTEN = cte("fx_text_lines") + "select path, line_no, line, true as in_order from fx_text_lines"


@query("scan_lines", _WRITTEN)
def _(i: Inputs):
    folder = staging(i, "scan")
    write_logs(i, i.text_lines, folder, _TAGGED)
    return _read_back(i, folder)


@query("scan_gzip", _WRITTEN)
def _(i: Inputs):
    folder = staging(i, "gzip")
    write_logs(i, i.text_lines, folder, _TAGGED, "gzip")
    return _read_back(i, folder)


@query("withhold_tail", _WRITTEN)
def _(i: Inputs):
    # Every line written by Spark is terminated, so nothing may be withheld.
    folder = staging(i, "tail")
    write_logs(i, i.text_lines, folder, _TAGGED)
    return _read_back(i, folder, withhold=True)


@query(
    "decode_lines",
    cte("fx_doc_lines", "fx_cri_lines")
    + """select path, line_no, 'utf-16le' as codec, line from fx_doc_lines
 union all select path, line_no, 'utf-16be-bom', line from fx_doc_lines
 union all select path, line_no, 'utf-8', line from fx_doc_lines
 union all select path, line_no, 'gbk', line from fx_cri_lines
 union all select path, line_no, 'windows1252', line from fx_doc_lines
 union all select path, line_no, 'iso8859-10', line from fx_cri_lines""",
)
def _(i: Inputs):
    out = None
    docs, cri = i.doc_lines, i.cri_lines.drop("chunk")
    for codec, charset, df in (
        ("utf-16le", "UTF-16LE", docs), ("utf-16be-bom", "UTF-16BE", docs), ("utf-8", "UTF-8", docs),
        ("gbk", "GBK", cri), ("windows1252", "windows-1252", docs), ("iso8859-10", "ISO-8859-1", cri),
    ):
        raw = df.withColumn("line", F.encode("line", charset))
        one = decode_lines(raw, codec).select("path", "line_no", F.lit(codec).alias("codec"), "line")
        out = one if out is None else out.unionByName(one)
    return out


def _split_sql(sep: str) -> str:
    return (
        f"select doc_id, '{{name}}' as name, cast(generate_subscripts(parts, 1) as bigint) as line_no, unnest(parts) as line "
        f"from (select doc_id, case when ends_with(t, {sep}) then parts[:-2] else parts end as parts from "
        f"(select doc_id, t, string_split(t, {sep}) as parts from (select doc_id, replace(text, chr(10), {sep}) as t from documents)))"
    )


_ENDS = {
    "line_feed": "chr(10)", "vertical_tab": "chr(11)", "form_feed": "chr(12)", "carriage_return": "chr(13)",
    "carriage_return_line_feed": "chr(13) || chr(10)", "next_line": "chr(133)",
    "line_separator": "chr(8232)", "paragraph_separator": "chr(8233)",
}


@query("split_lines", " union all ".join(_split_sql(sep).replace("{name}", name) for name, sep in _ENDS.items()))
def _(i: Inputs):
    from ..sources.files import TERMINATORS

    docs = i.table("documents").select("doc_id", "text")
    out = None
    for name in _ENDS:
        texts = docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit(TERMINATORS[name])))
        one = split_lines(texts, name, keys=("doc_id",)).select("doc_id", F.lit(name).alias("name"), "line_no", "line")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "drop_overlong",
    cte("fx_doc_lines")
    + """, o as (select *, sum(octet_length(encode(line)) + 1) over (partition by path order by line_no) as end_offset from fx_doc_lines)
select path, line_no, cast(end_offset as bigint) as end_offset, line from o where octet_length(encode(line)) <= 200""",
)
def _(i: Inputs):
    return drop_overlong_lines(with_offsets(i.doc_lines), 200).select("path", "line_no", "end_offset", "line")


@query("trim_bom", cte("fx_doc_lines") + "select path, line_no, line from fx_doc_lines")
def _(i: Inputs):
    mark = F.lit("﻿")
    dirty = F.when(F.col("line_no") % 3 == 0, F.concat(mark, mark, "line")).when(
        F.col("line_no") % 3 == 1, F.concat("line", mark)
    ).otherwise(F.concat(mark, "line", mark))
    return trim_bom(i.doc_lines.withColumn("line", dirty)).select("path", "line_no", "line")


@query(
    "strip_newline",
    cte("fx_doc_lines")
    + """, ended as (select path, line_no, line || case line_no % 3 when 0 then chr(13) else '' end as line from fx_doc_lines)
select path, line_no, line as auto, line || chr(13) as line_feed from ended""",
)
def _(i: Inputs):
    # Every third line ends in a CR of its own, which the terminator's CR doesn't cover.
    own = F.when(F.col("line_no") % 3 == 0, F.lit("\r")).otherwise(F.lit(""))
    df = i.doc_lines.withColumn("line", F.concat("line", own)).withColumns(
        {"auto": F.concat("line", F.lit("\r\n")), "line_feed": F.concat("line", F.lit("\r\n"))}
    )
    return strip_newline(strip_newline(df, "auto", "auto"), "line_feed", "line_feed").select(
        "path", "line_no", "auto", "line_feed"
    )


@query(
    "with_offsets",
    cte("fx_text_lines", "fx_doc_lines")
    + """, a as (select path, line_no, line from fx_text_lines union all select path, line_no, line from fx_doc_lines),
 o as (select path, line_no, octet_length(encode(line)) + 1 as n,
   sum(octet_length(encode(line)) + 1) over (partition by path order by line_no) as e from a)
select path, line_no, cast(e - n as bigint) as "offset", cast(e as bigint) as end_offset from o""",
)
def _(i: Inputs):
    cols = ["path", "line_no", "offset", "end_offset"]
    return with_offsets(i.text_lines).select(cols).unionByName(with_offsets(i.doc_lines).select(cols))


@query("with_line_numbers", cte("fx_text_lines") + "select path, line_no as number, line from fx_text_lines")
def _(i: Inputs):
    # Row numbers as a scan gives them: counting up by one inside a chunk only.
    rows = i.text_lines.withColumn("mid", F.col("line_no") + F.unix_timestamp("chunk") * 1000).drop("line_no")
    return with_line_numbers(rows).select(
        "path", F.col("line_no").alias("number"), "line"
    )


@query(
    "normalise_paths",
    cte("fx_paths")
    + r"""select job, path, min(pos) as pos from (
 select job, pos, case when p like '/%' then regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '/+', '/', 'g'),
   '/[^/.]+/\.\.', '', 'g'), '/\.$', ''), '(.)/$', '\1') else replace(p, '/', chr(92)) end as path
 from (select job, pos, trim(raw) as p from fx_paths) t where p <> '') u group by job, path""",
)
def _(i: Inputs):
    return normalise_paths(i.paths)


_PATTERNS = [
    LogPattern("", "text", "ignored"),
    LogPattern(".*_server.json$", "json", "server"),
    LogPattern(r"gc.log$", "multiline", "gc"),
    LogPattern(r"^\d+\.log$", "text", "numbered"),
    LogPattern(r"\.log$", "multiline", "rest"),
]


@query(
    "route_files",
    cte("fx_listing")
    + r""", b as (select path, regexp_extract(path, '[^/]*$') as name from fx_listing),
 r as (select path, case when regexp_matches(name, '.*_server.json$') then 0 when regexp_matches(name, 'gc.log$') then 1
   when regexp_matches(name, '^\d+\.log$') then 2 when regexp_matches(name, '\.log$') then 3 end as pattern_index from b)
select path, pattern_index, ['json', 'multiline', 'text', 'multiline'][pattern_index + 1] as log_type,
 ['server', 'gc', 'numbered', 'rest'][pattern_index + 1] as log_name from r where pattern_index is not null""",
)
def _(i: Inputs):
    return route_files(i.listing, _PATTERNS).select("path", "pattern_index", "log_type", "log_name")


@query(
    "route_catalogue",
    cte("fx_listing")
    + r""", r as (select path, case when path like '%\_server.json' escape '\' then 'server' when path like '%\_index\_search\_slowlog.json' escape '\' then 'index_search_slowlog'
   when path like '%\_deprecation.json' escape '\' then 'deprecation' when path like '%\_audit.json' escape '\' then 'audit'
   when regexp_matches(path, 'gc.log$') then 'gc' when regexp_matches(path, '..log$') then 'server' end as log_name from fx_listing)
select path, log_name, log_name as metadata_name, case when path like '%json' then 'json' else 'multiline' end as log_type from r where log_name is not null""",
)
def _(i: Inputs):
    routed = route_files(i.listing, search_log_patterns({"server": {"text": True}}))
    return routed.select("path", "log_name", as_text(F.col("pattern_metadata")["name"]).alias("metadata_name"), "log_type")


# ---- state -----------------------------------------------------------------

_CHANGES = """, c as (select l.path, l.size, l.inode, s.resume_offset as old, case when s.inode is null or s.inode <> l.inode then 'create'
   when s.mtime <> l.mtime and s.size >= l.size then 'truncate' when s.mtime <> l.mtime then 'write' end as op
 from fx_listing l left join fx_state s on l.path = s.path)
"""


@query(
    "classify_changes",
    cte("fx_state") + _CHANGES + "select path, op, size from c where op is not null",
)
def _(i: Inputs):
    return classify_changes(i.listing, i.state).select("path", "op", "size")


@query(
    "resume_offsets",
    cte("fx_state")
    + _CHANGES
    + "select path, op, cast(case when op = 'write' then old else 0 end as bigint) as start_offset from c where op is not null",
)
def _(i: Inputs):
    return classify_changes(i.listing, i.state).select("path", "op", "start_offset")


@query(
    "advance_state",
    cte("fx_state")
    + _CHANGES
    + """, r as (select path, size, inode from c where op is not null)
select coalesce(s.path, r.path) as path, coalesce(r.size, s.size) as size, coalesce(r.inode, s.inode) as inode,
 coalesce(r.size, s.resume_offset) as resume_offset from fx_state s full outer join r on s.path = r.path""",
)
def _(i: Inputs):
    read = classify_changes(i.listing, i.state).withColumn("resume_offset", F.col("size"))
    return advance_state(i.state, read).select("path", "size", "inode", "resume_offset")


@query(
    "resolve_links",
    cte("fx_listing")
    + """, p as (select coalesce(link_target, path) as path, path as walk, size, inode from fx_listing)
select path, arg_min(size, walk) as size, arg_min(inode, walk) as inode from p group by path""",
)
def _(i: Inputs):
    return resolve_links(i.listing).select("path", "size", "inode")


# ---- envelope ----------------------------------------------------------------

_NOW = "2025-01-01T00:00:00Z"
_EVENTS = """, s as (select *, sum(case when starts_with(line, '[') then 1 else 0 end) over (partition by path order by line_no) as ev,
   sum(length(line) + 1) over (partition by path order by line_no) as upto from fx_text_lines),
 e as (select path, min(line_no) as line_from, string_agg(line, chr(10) order by line_no) as content, max(upto) as end_offset from s group by path, ev)
"""


def _text_events(i: Inputs) -> DataFrame:
    return assemble(i.text_lines, r"^\[", offsets=True)


@query(
    "wrap_log_event",
    cte("fx_text_lines")
    + _EVENTS
    + r"""select path, line_from, 'multiline' as log_type, 'job' as source, 'pattern' as name, path as file_path, cast(end_offset as bigint) as file_offset,
 'logs' as queue, 'host-1' as hostname, content as message,
 regexp_extract(content, '\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2},\d{3}') as timestamp from e""",
)
def _(i: Inputs):
    events = _text_events(i).withColumns(
        {
            "payload": text_payload("content"),
            "timestamp": extract_timestamp("content", SEARCH_LOG_TIMESTAMPS),
            "log_type": F.lit("multiline"),
            "pattern_metadata": F.create_map(F.lit("name"), F.lit("pattern").cast("variant")),
        }
    )
    wrapped = wrap_log_event(
        events, _NOW, collector_literal(hostname="host-1"), {"source": "job", "name": "job", "file": "job"},
        pattern_metadata="pattern_metadata",
    )
    meta = F.col("metadata")
    return wrapped.select(
        "path",
        F.col("line_from").cast("bigint"),
        as_text(meta["log_type"]).alias("log_type"),
        as_text(meta["source"]).alias("source"),
        as_text(meta["name"]).alias("name"),
        F.try_variant_get(meta["file"], "$.path", "string").alias("file_path"),
        F.try_variant_get(meta["file"], "$.offset", "bigint").alias("file_offset"),
        "collector.queue",
        "collector.hostname",
        as_text(F.col("payload")["message"]).alias("message"),
        "timestamp",
    )


@query(
    "text_payload",
    cte("fx_text_lines") + """select path, line_no, line as message, '["message"]' as keys from fx_text_lines""",
)
def _(i: Inputs):
    df = i.text_lines.withColumn("payload", text_payload("line"))
    return df.select(
        "path", "line_no", as_text(F.col("payload")["message"]).alias("message"),
        F.to_json(F.map_keys("payload")).alias("keys"),
    )


@query(
    "adapt_level",
    cte("fx_ev")
    + "select event_id, case when event_id % 3 = 0 then 'kept' else level end as level, false as dotted from fx_ev",
)
def _(i: Inputs):
    # Every third event has only `level`; the others have both, the dotted one wins.
    payload = F.create_map(F.lit("level"), F.lit("kept").cast("variant"))
    payload = F.when(F.col("event_id") % 3 == 0, payload).otherwise(put(payload, "log.level", F.col("level").cast("variant")))
    df = i.ev.select("event_id", payload.alias("p")).withColumn("p", adapt_level("p"))
    return df.select(
        "event_id", as_text(F.col("p")["level"]).alias("level"), F.map_contains_key("p", "log.level").alias("dotted")
    )


@query(
    "default_timestamp",
    cte("fx_text_lines")
    + rf"""select path, line_no, coalesce(nullif(regexp_extract(line, '\d{{4}}-\d{{1,2}}-\d{{1,2}}T\d{{1,2}}:\d{{1,2}}:\d{{1,2}},\d{{3}}'), ''), '{_NOW}') as timestamp from fx_text_lines""",
)
def _(i: Inputs):
    found = extract_timestamp("line", SEARCH_LOG_TIMESTAMPS)
    return i.text_lines.select("path", "line_no", default_timestamp(found, _NOW).alias("timestamp"))


@query(
    "merge_labels",
    cte("fx_nodes")
    + """select node_id, 'custom' as ip, nullif(cluster_uuid, '') as cluster_uuid, 'prod' as env, node_name,
 case when cluster_uuid = '' then 4 else 5 end as n from fx_nodes""",
)
def _(i: Inputs):
    from ..operators.envelope import labels

    base = labels(
        {"node_id": F.col("node_id"), "node_name": F.col("node_name"), "ip": F.col("host")},
        {"cluster_uuid": F.col("cluster_uuid")},
    )
    df = i.nodes.withColumn("l", merge_labels(base, {"ip": "custom", "env": "prod"}))
    names = ("ip", "cluster_uuid", "env", "node_name")
    return df.select("node_id", *[F.col("l")[n].alias(n) for n in names], F.size("l").alias("n"))


@query(
    "jobs_from_nodes",
    cte("fx_nodes")
    + """select node_id, 'configured' as mode, unnest(['/data/logs', '/data/gc']) as logs_path, 'logs' as queue, 'elasticsearch' as category,
   node_name, cluster_uuid, 'x' as team from fx_nodes
 union all select node_id, 'settings', '/var/log/' || node_id, 'logs', 'override', node_name, cluster_uuid, null from fx_nodes where node_id not like '%0'""",
)
def _(i: Inputs):
    nodes = i.nodes.select(
        "node_id", "node_name", "cluster_uuid", F.lit("c1").alias("cluster_id"), F.lit("main").alias("cluster_name"),
        F.lit("9200").alias("port"),
        F.when(~F.col("node_id").endswith("0"), F.concat(F.lit("/var//log/"), "node_id", F.lit("/."))).alias("path_logs"),
    )
    fixed = jobs_from_nodes(nodes, ["/data/logs/", "/data/gc", " /data/logs"], custom_labels={"team": "x"})
    from_settings = jobs_from_nodes(nodes, metadata={"category": "override"})

    def flat(df: DataFrame, mode: str) -> DataFrame:
        def label(name: str):
            return F.try_variant_get(F.col("metadata")["labels"], f"$.{name}", "string").alias(name)

        return df.select(
            "node_id", F.lit(mode).alias("mode"), "logs_path", "queue",
            as_text(F.col("metadata")["category"]).alias("category"), label("node_name"), label("cluster_uuid"), label("team"),
        )

    return flat(fixed, "configured").unionByName(flat(from_settings, "settings"))


@query(
    "json_log_events",
    cte("fx_json_lines")
    + """, j as (select path, min(line_no) as line_from, string_agg(line, chr(10) order by line_no) as content from fx_json_lines group by path, event_id)
select path, line_from, content::json->>'$."log.level"' as level, content::json->'node'->>'name' as node_name, false as has_id,
 content::json->>'timestamp' as timestamp from j where json_valid(content)""",
)
def _(i: Inputs):
    """JSON log to envelope: extraction, pruning, level."""
    from ..functions.fields import pick_text, remove_fields
    from ..sources.catalogue import ENVELOPE_KEYS, TIMESTAMP_KEYS

    lines = i.json_lines.select("path", "chunk", "line_no", "line")
    events = accepted(read_json_events(lines, offsets=True)).withColumns(
        {
            "timestamp": pick_text("json", TIMESTAMP_KEYS),
            "payload": remove_fields("json", [k for k in ENVELOPE_KEYS if k != "node.name"]),
            "log_type": F.lit("json"),
        }
    )
    wrapped = wrap_log_event(events, _NOW)
    return wrapped.select(
        "path",
        F.col("line_from").cast("bigint"),
        as_text(F.col("payload")["level"]).alias("level"),
        as_text(lookup("payload", "node.name")).alias("node_name"),
        lookup("payload", "node.id").isNotNull().alias("has_id"),
        "timestamp",
    )
