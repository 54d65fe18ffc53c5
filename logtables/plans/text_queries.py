"""Matching, timestamps and JSON queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import as_text, lookup, pick_text, remove_fields
from ..functions.match import contains_text, matches, matches_all, matches_any
from ..functions.timestamps import (
    SEARCH_LOG_TIMESTAMPS,
    decode_ipv4,
    extract_timestamp,
    format_timestamp,
    parse_timestamp,
    timestamp_layout,
)
from ..operators.jsonlog import (
    accepted,
    decode_json,
    decode_json_field,
    lift_document_id,
    merge_json,
    read_json_events,
    rejected,
)
from .fixtures import Inputs, cte
from .registry import query

# ---- matching -------------------------------------------------------------


@query(
    "match_contains",
    cte("fx_doc_lines")
    + r"""select path, line_no, contains(line, 'eau') as literal, contains(line, 'eau') or contains(line, 'the ') as either,
 regexp_matches(line, '[aeiou]{3}t') as regex, regexp_matches(line, '\d\s+[A-Z]') as spaced
from fx_doc_lines where regexp_matches(line, '[a-z]')""",
)
def _(i: Inputs):
    return i.doc_lines.filter(matches("line", "[a-z]")).select(
        "path",
        "line_no",
        matches("line", "^.*eau.*$").alias("literal"),
        matches("line", "(eau|the )").alias("either"),
        matches("line", "[aeiou]{3}t").alias("regex"),
        matches("line", r"\d\s+[A-Z]").alias("spaced"),
    )


@query(
    "match_prefix",
    cte("fx_text_lines")
    + r"""select path, line_no, line from fx_text_lines where starts_with(line, 'END')
 union all select path, line_no, line from fx_text_lines where starts_with(line, '  at') or starts_with(line, '[2024-01-02')""",
)
def _(i: Inputs):
    cols = ["path", "line_no", "line"]
    one = i.text_lines.filter(matches("line", "^END")).select(cols)
    return one.unionByName(i.text_lines.filter(matches("line", r"^(  at|\[2024-01-02)")).select(cols))


@query(
    "match_date_prefix",
    cte("fx_cri_lines")
    + r"""select path, line_no, regexp_matches(line, '^20\d{2}-\d{2}-\d{2}T0') as early
 from fx_cri_lines where regexp_matches(line, '^\d{4}-\d{2}-\d{2}')""",
)
def _(i: Inputs):
    rows = i.cri_lines.filter(matches("line", r"^\d{4}-\d{2}-\d{2}"))
    return rows.select("path", "line_no", matches("line", r"^20\d{2}-\d{2}-\d{2}T0").alias("early"))


@query(
    "match_exact",
    cte("fx_text_lines")
    + r"""select path, line_no, line = 'END' as whole, line in ('END', '  at frame.1') as one_of, contains(line, 'frame') as inside,
 regexp_full_match(line, '\s+at .*[12]') as regex from fx_text_lines""",
)
def _(i: Inputs):
    return i.text_lines.select(
        "path",
        "line_no",
        matches("line", "END", exact=True).alias("whole"),
        matches("line", r"END|  at frame\.1", exact=True).alias("one_of"),
        matches("line", ".*frame.*", exact=True).alias("inside"),
        matches("line", r"\s+at .*[12]", exact=True).alias("regex"),
    )


_WORDS = "string_split(line, ' ')"


@query(
    "match_any",
    cte("fx_text_lines")
    + rf"""select path, line_no, len(list_filter({_WORDS}, lambda x: contains(x, 'user=1'))) > 0 as some,
 list_contains({_WORDS}, 'END') as exact, false as none from fx_text_lines""",
)
def _(i: Inputs):
    words = i.text_lines.withColumns({"w": F.split("line", " "), "e": F.array().cast("array<string>")})
    return words.select(
        "path", "line_no", matches_any("w", "user=1").alias("some"),
        matches_any("w", "END", exact=True).alias("exact"), matches_any("e", ".*").alias("none"),
    )


@query(
    "match_all",
    cte("fx_text_lines")
    + rf"""select path, line_no, len(list_filter({_WORDS}, lambda x: not regexp_matches(x, '[0-9=]'))) = 0 as every,
 line = 'END' as exact, true as none from fx_text_lines""",
)
def _(i: Inputs):
    words = i.text_lines.withColumns({"w": F.split("line", " "), "e": F.array().cast("array<string>")})
    return words.select(
        "path", "line_no", matches_all("w", "[0-9=]").alias("every"),
        matches_all("w", "END", exact=True).alias("exact"), matches_all("e", "x").alias("none"),
    )


@query(
    "match_literal",
    """select page_id, contains(html, '.*') as pattern_text, contains(html, '<li>') as items, html = '' as blank from pages""",
)
def _(i: Inputs):
    return i.table("pages").select(
        "page_id",
        contains_text("html", ".*").alias("pattern_text"),
        contains_text("html", "<li>").alias("items"),
        contains_text("html", "").alias("blank"),
    )


@query(
    "strip_comments",
    """with t as (select doc_id, unnest(string_split(replace(text, 'The ', '#The '), chr(10))) as line,
   generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
select doc_id, coalesce(string_agg(line, '' order by n) filter (where not starts_with(line, '#')), '') as content from t group by doc_id""",
)
def _(i: Inputs):
    from ..operators.documents import strip_comments

    marked = i.table("documents").select("doc_id", F.replace("text", F.lit("The "), F.lit("#The ")).alias("text"))
    return strip_comments(marked).select("doc_id", F.col("text").alias("content"))


# ---- timestamps ------------------------------------------------------------


@query(
    "timestamp_patterns",
    cte("fx_text_lines")
    + r"""select path, line_no, nullif(regexp_extract(line, '\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2},\d{3}'), '') as timestamp from fx_text_lines""",
)
def _(i: Inputs):
    return i.text_lines.select("path", "line_no", extract_timestamp("line", SEARCH_LOG_TIMESTAMPS).alias("timestamp"))


_STAMP = """sec_text || case event_id % 6 when 0 then '.' || ms || 'Z' when 1 then '.' || ms || '456Z' when 2 then '.' || ms || '456789Z'
 when 3 then '.' || ms when 4 then '.12Z' else 'Z' end"""


@query(
    "parse_timestamp",
    cte("fx_ev")
    + f"""select event_id, epoch_us(try_cast(case when event_id % 6 in (0, 1) then left(t, length(t) - 1)
   when event_id % 6 = 2 then left(t, length(t) - 4) end as timestamp)) as micros
 from (select event_id, {_STAMP} as t from fx_ev) x""",
)
def _(i: Inputs):
    text = i.ev.select("event_id", F.expr(_STAMP).alias("t"))
    return text.select("event_id", F.unix_micros(parse_timestamp("t")).alias("micros"))


@query(
    "format_timestamps",
    """select event_id,
 strftime(ts, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') as plain,
 strftime(ts, '%y') || '/' || month(ts) || '/' || day(ts) || ' ' || dayofyear(ts) || ' ' || lpad(dayofyear(ts)::varchar, 3, '0') as dates,
 strftime(ts, '%A') || ',' || strftime(ts, '%a') || ',' || strftime(ts, '%B') || ',' || strftime(ts, '%b') || ',' || dayofweek(ts) as names,
 isoyear(ts) || '-W' || lpad(week(ts)::varchar, 2, '0') as week,
 (hour(ts) % 12) || ' ' || (hour(ts) % 12 + 1) || ' ' || (hour(ts) + 1) || ' ' || case when hour(ts) < 12 then 'AM' else 'PM' end as hours,
 lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') || '000' as nanos,
 left(lpad((epoch_us(ts) % 1000000)::varchar, 6, '0'), 2) || ' o''clock' as cut
from events""",
)
def _(i: Inputs):
    def f(pattern: str):
        return format_timestamp("ts", pattern)

    return i.table("events").select(
        "event_id",
        f("yyyy-MM-dd HH:mm:ss").alias("plain"),
        f("yy/M/d D DDD").alias("dates"),
        f("EEEE,EEE,MMMM,MMM,e").alias("names"),
        f("xxxx-'W'ww").alias("week"),
        f("K h k a").alias("hours"),
        f("n").alias("nanos"),
        f("SS' o''''clock'").alias("cut"),
    )


@query(
    "timestamp_layout",
    """with t as (select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') as s, lpad((epoch_us(ts) % 1000000)::varchar, 6, '0') as u from events)
select event_id, s || left(u, 3) || 'Z' as milli, s || case when right(u, 3) = '000' then left(u, 3) else u end || 'Z' as micro,
 s || case when right(u, 3) = '000' then left(u, 3) else u end || '+00:00' as nano_local from t""",
)
def _(i: Inputs):
    return i.table("events").select(
        "event_id",
        format_timestamp("ts", timestamp_layout()).alias("milli"),
        format_timestamp("ts", timestamp_layout("microsecond")).alias("micro"),
        format_timestamp("ts", timestamp_layout("nanosecond", local=True)).alias("nano_local"),
    )


@query(
    "decode_ipv4",
    """with t as (select o_orderkey, (o_orderkey * 2654435761) % 4294967296 as v from orders)
select o_orderkey, ((v >> 24) & 255) || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) as big,
 (v & 255) || '.' || ((v >> 8) & 255) || '.' || ((v >> 16) & 255) || '.' || ((v >> 24) & 255) as little from t""",
)
def _(i: Inputs):
    v = (F.col("o_orderkey") * F.lit(2654435761)) % F.lit(4294967296)
    return i.table("orders").select(
        "o_orderkey", decode_ipv4(v).alias("big"), decode_ipv4(v, "little").alias("little")
    )


# ---- JSON ------------------------------------------------------------------

_JSON = (
    cte("fx_json_lines")
    + """, j as (select path, min(line_no) as line_from, string_agg(line, chr(10) order by line_no) as content from fx_json_lines group by path, event_id),
 d as (select *, case when json_valid(content) then content::json end as o from j)
"""
)


def _text(key: str):
    return as_text(lookup("json", key))


@query(
    "json_events",
    _JSON
    + """select path, line_from, o->>'message' as message, cast(o->>'cents' as bigint) as cents, o->'node'->>'name' as node,
 o->>'$."log.level"' as level, content is null as rejected from d where o is not null
 union all select path, line_from, null, null, null, null, true from d where o is null""",
)
def _(i: Inputs):
    events = read_json_events(i.json_lines.select("path", "chunk", "line_no", "line"))
    good = accepted(events).select(
        "path",
        F.col("line_from").cast("bigint"),
        _text("message").alias("message"),
        F.col("json")["cents"].cast("bigint").alias("cents"),
        _text("node.name").alias("node"),
        _text("log.level").alias("level"),
        F.lit(False).alias("rejected"),
    )
    bad = rejected(events).select("path", F.col("line_from").cast("bigint"), F.lit(True).alias("rejected"))
    return good.unionByName(bad, allowMissingColumns=True)


def _contents(i: Inputs) -> DataFrame:
    """The same event texts without the parsing."""
    from ..operators.assemble import assemble

    lines = i.json_lines.select("path", "chunk", "line_no", "line")
    return assemble(lines, "^{").select("path", F.col("line_from").cast("bigint"), "content")


@query(
    "decode_json",
    _JSON
    + """select path, line_from, case when o is null then content else o->>'message' end as content,
 o is null as failed, o->>'timestamp' as timestamp from d""",
)
def _(i: Inputs):
    df = decode_json(_contents(i), "message")
    return df.select("path", "line_from", "content", F.col("json").isNull().alias("failed"), _text("timestamp").alias("timestamp"))


@query(
    "decode_json_errors",
    _JSON
    + """, k as (select 'cents' as key union all select 'absent' union all select 'message')
select path, line_from, key, case when o is null then content when key = 'message' then o->>'message' else '' end as content,
 case when o is null then 'Error decoding JSON' when key = 'absent' then 'Key ''absent'' not found'
   when key = 'cents' then 'Value of key ''cents'' is not a string' end as error,
 case when o is null or key <> 'message' then 'json' end as kind from d cross join k""",
)
def _(i: Inputs):
    base = _contents(i)
    out = None
    for key in ("cents", "absent", "message"):
        df = decode_json(base, key, add_error_key=True).select(
            "path", "line_from", F.lit(key).alias("key"), "content",
            F.try_variant_get(F.col("json")["error"], "$.message", "string").alias("error"),
            F.try_variant_get(F.col("json")["error"], "$.type", "string").alias("kind"),
        )
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "decode_json_field",
    _JSON
    + """select path, line_from, true as keyed, case when o is null then content else o->>'message' end as decoded, cast(null as varchar) as message,
 o->'node'->>'id' as document_id, (o->'node'->>'name') is not null as has_name, false as has_id from d
union all select path, line_from, false, o->>'message', case when o is null then content end,
 o->'node'->>'id', (o->'node'->>'name') is not null, false from d""",
)
def _(i: Inputs):
    base = _contents(i).withColumnRenamed("content", "raw")

    def run(message_key: str | None) -> DataFrame:
        df = decode_json_field(base, "raw", "doc", message_key, add_error_key=True, document_id="node.id")
        return df.select(
            "path", "line_from", F.lit(message_key is not None).alias("keyed"),
            as_text(lookup("doc", "message")).alias("decoded"), "message", "document_id",
            as_text(lookup("doc", "node.name")).isNotNull().alias("has_name"),
            lookup("doc", "node.id").isNotNull().alias("has_id"),
        )

    return run("message").unionByName(run(None))


@query(
    "document_id",
    _JSON
    + """select path, line_from, o->>'$."cluster.name"' as by_literal, o->'node'->>'id' as by_path, cast(null as varchar) as by_number,
 false as literal_left, false as path_left, true as number_left, o->'node'->>'name' as node from d where o is not null""",
)
def _(i: Inputs):
    df = accepted(read_json_events(i.json_lines.select("path", "chunk", "line_no", "line")))
    df = lift_document_id(df, "cluster.name").withColumnRenamed("document_id", "by_literal")
    df = lift_document_id(df, "node.id").withColumnRenamed("document_id", "by_path")
    df = lift_document_id(df, "cents").withColumnRenamed("document_id", "by_number")
    return df.select(
        "path", F.col("line_from").cast("bigint"), "by_literal", "by_path", "by_number",
        lookup("json", "cluster.name").isNotNull().alias("literal_left"),
        lookup("json", "node.id").isNotNull().alias("path_left"),
        lookup("json", "cents").isNotNull().alias("number_left"),
        _text("node.name").alias("node"),
    )


@query(
    "merge_json",
    _JSON
    + """select path, line_from, 'root' as kept, o->>'type' as replaced, o->>'message' as message,
 o->>'$."log.level"' as level, false as stamped from d where o is not null""",
)
def _(i: Inputs):
    df = accepted(read_json_events(i.json_lines.select("path", "chunk", "line_no", "line")))
    root = F.expr("map('type', cast('root' as variant), '@timestamp', cast('x' as variant), 'host', cast('h' as variant))")
    # Both merges of one row; a line without a path is in no file, and left out.
    df = df.filter(F.col("path").isNotNull()).withColumns({"fields": root, "k": root, "same": F.col("json")})
    both = merge_json(merge_json(df, "k", "same"), overwrite_keys=True, expand_keys=True)
    return both.select(
        "path", F.col("line_from").cast("bigint"),
        as_text(F.col("k")["type"]).alias("kept"),
        as_text(F.col("fields")["type"]).alias("replaced"),
        as_text(F.col("fields")["message"]).alias("message"),
        F.try_variant_get(F.col("fields")["log"], "$.level", "string").alias("level"),
        F.map_contains_key("fields", "@timestamp").alias("stamped"),
    )


@query(
    "remove_fields",
    _JSON
    + """select path, line_from, 'node' as left_node, o->'node'->>'name' as node_name, '["cents","message","node","timestamp"]' as keys from d where o is not null""",
)
def _(i: Inputs):
    df = accepted(read_json_events(i.json_lines.select("path", "chunk", "line_no", "line")))
    gone = remove_fields("json", ["type", "log.level", "cluster.name", "node.id", "props", "absent.path"])
    df = df.withColumn("json", gone)
    return df.select(
        "path", F.col("line_from").cast("bigint"),
        F.when(lookup("json", "node.id").isNull() & lookup("json", "node").isNotNull(), F.lit("node")).alias("left_node"),
        _text("node.name").alias("node_name"),
        F.to_json(F.array_sort(F.map_keys("json"))).alias("keys"),
    )


@query(
    "timestamp_fields",
    _JSON
    + """select path, line_from, o->>'timestamp' as timestamp, o->'node'->>'name' as fallback from d where o is not null""",
)
def _(i: Inputs):
    df = accepted(read_json_events(i.json_lines.select("path", "chunk", "line_no", "line")))
    return df.select(
        "path", F.col("line_from").cast("bigint"),
        pick_text("json", ["@timestamp", "timestamp"]).alias("timestamp"),
        pick_text("json", ["cents", "node.name", "message"]).alias("fallback"),
    )
