"""Assembly, container and flagship queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import SEARCH_LOG_TIMESTAMPS, extract_timestamp
from ..operators.assemble import assemble, assemble_count, assemble_while, truncate_messages
from ..operators.container import filter_stream, join_partials, parse_container
from .fixtures import Inputs, cte
from .registry import query



def _events(df: DataFrame) -> DataFrame:
    return df.select(
        "path", F.col("line_from").cast("bigint"), F.col("line_to").cast("bigint"), F.col("lines").cast("bigint"), "content"
    )


def _islands(view: str, marked: str, start: str) -> str:
    """Events from a per-line start condition over window columns."""
    return (
        cte(view)
        + f""", m as (select path, line_no, line, {marked} from {view}),
 s as (select *, sum(case when {start} then 1 else 0 end) over (partition by path order by line_no) as ev from m)
select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 string_agg(line, chr(10) order by line_no) as content from s group by path, ev"""
    )


_LEVEL = r"\]\[(ERROR|WARN|INFO|DEBUG)\]"
_FLAG_TEXT = "array_join(flags, ',')"


@query(
    "assemble_after_negate",
    _islands("fx_text_lines", r"regexp_matches(line, '^\[') as b", "line_no = 1 or b"),
)
def _(i: Inputs):
    return _events(assemble(i.text_lines, r"^\["))


@query(
    "assemble_after",
    _islands("fx_text_lines", r"regexp_matches(line, '^(\s|END)') as b", "line_no = 1 or not b"),
)
def _(i: Inputs):
    return _events(assemble(i.text_lines, r"^(\s|END)", negate=False))


@query(
    "assemble_before",
    _islands(
        "fx_text_lines",
        "lag(contains(line, 'error')) over (partition by path order by line_no) as b",
        "line_no = 1 or not b",
    ),
)
def _(i: Inputs):
    return _events(assemble(i.text_lines, "error", negate=False, match="before"))


@query(
    "assemble_before_negate",
    _islands(
        "fx_text_lines",
        r"lag(regexp_matches(line, 'frame\.2$|END|view')) over (partition by path order by line_no) as b",
        "line_no = 1 or b",
    ),
)
def _(i: Inputs):
    # An event can be long here; the limit is lifted so that the text is whole.
    return _events(assemble(i.text_lines, r"frame\.2$|END|view", match="before", max_lines=None))


@query(
    "assemble_flush",
    cte("fx_text_lines")
    + r""", m as (select *, line = 'END' or contains(line, 'signup') as f, regexp_matches(line, '^\[') as b from fx_text_lines),
 r as (select *, max(case when not f then line_no else 0 end) over (partition by path order by line_no) as p from m),
 c as (select *, f and (line_no - p) % 2 = case when p = 0 then 0 else 1 end as closes from r),
 s as (select *, line_no = 1 or lag(closes) over (partition by path order by line_no) or (not f and b) as st from c),
 g as (select *, sum(case when st then 1 else 0 end) over (partition by path order by line_no) as ev from s)
select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 string_agg(line, chr(10) order by line_no) as content from g group by path, ev""",
)
def _(i: Inputs):
    return _events(assemble(i.text_lines, r"^\[", flush_pattern="^END$|signup"))


@query(
    "assemble_count",
    cte("fx_text_lines")
    + """select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 string_agg(line, chr(10) order by line_no) as content from fx_text_lines group by path, (line_no - 1) // 7""",
)
def _(i: Inputs):
    return _events(assemble_count(i.text_lines, 7))


@query(
    "assemble_count_documents",
    cte("fx_doc_lines")
    + """select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 regexp_replace(string_agg(line, chr(10) order by line_no), '^\\n+', '') as content from fx_doc_lines group by path, (line_no - 1) // 5""",
)
def _(i: Inputs):
    return _events(assemble_count(i.doc_lines, 5))


def _while_sql(negate: bool) -> str:
    hit = "not b" if negate else "b"
    return (
        cte("fx_text_lines")
        + rf""", m as (select *, regexp_matches(line, '^(\s|END)') as b from fx_text_lines),
 w as (select *, ({hit}) as h, coalesce(lag({hit}) over (partition by path order by line_no), false) as ph from m),
 s as (select *, sum(case when h and ph then 0 else 1 end) over (partition by path order by line_no) as ev from w)
select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 string_agg(line, chr(10) order by line_no) as content from s group by path, ev"""
    )


@query("assemble_while", _while_sql(False))
def _(i: Inputs):
    return _events(assemble_while(i.text_lines, r"^(\s|END)"))


@query("assemble_while_negate", _while_sql(True))
def _(i: Inputs):
    return _events(assemble_while(i.text_lines, r"^(\s|END)", negate=True, max_lines=None))


# Groups of twenty lines against a limit on lines, then on bytes.
_GROUPS = (
    cte("fx_text_lines")
    + """, g as (select *, (line_no - 1) // 20 as ev,
   row_number() over (partition by path, (line_no - 1) // 20 order by line_no) as n,
   sum(length(line)) over (partition by path, (line_no - 1) // 20 order by line_no) as upto from fx_text_lines)
"""
)


@query(
    "limit_lines",
    _GROUPS
    + """select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 string_agg(case when n <= 3 then line end, chr(10) order by line_no) as content from g group by path, ev""",
)
def _(i: Inputs):
    return _events(assemble_count(i.text_lines, 20, max_lines=3))


@query(
    "limit_bytes",
    _GROUPS
    + """, k as (select *, upto - length(line) + n - 1 as before from g)
select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 string_agg(case when before < 100 then left(line, 100 - cast(before as integer)) end, chr(10) order by line_no) as content
from k group by path, ev""",
)
def _(i: Inputs):
    return _events(assemble_count(i.text_lines, 20, max_bytes=100))


@query(
    "event_flags",
    _GROUPS
    + """, k as (select *, upto - length(line) + n - 1 as before from g),
 e as (select path, min(line_no) as line_from, sum(length(line)) as total,
   sum(case when before < 100 then least(length(line), 100 - before) else 0 end) as taken,
   sum(case when before < 100 then 1 else 0 end) as stored from k group by path, ev)
select path, line_from, concat_ws(',', case when total > taken then 'truncated' end, case when stored > 1 then 'multiline' end) as flags from e""",
)
def _(i: Inputs):
    return assemble_count(i.text_lines, 20, max_bytes=100).select(
        "path", F.col("line_from").cast("bigint"), F.expr(_FLAG_TEXT).alias("flags")
    )


@query(
    "join_separator",
    cte("fx_text_lines")
    + """select path, min(line_no) as line_from, max(line_no) as line_to, count(*) as lines,
 string_agg(line, ' | ' order by line_no) as content from fx_text_lines group by path, (line_no - 1) // 4
union all
select path, min(line_no), max(line_no), count(*), string_agg(line, '' order by line_no) from fx_text_lines group by path, (line_no - 1) // 3""",
)
def _(i: Inputs):
    spaced = _events(assemble_count(i.text_lines, 4, separator=" | "))
    return spaced.unionByName(_events(assemble_count(i.text_lines, 3, skip_newline=True)))


@query(
    "truncate_messages",
    cte("fx_text_lines")
    + """select path, line_no, left(line, 30) as content, case when length(line) > 30 then 'truncated' else '' end as flags from fx_text_lines""",
)
def _(i: Inputs):
    df = i.text_lines.withColumn("content", F.col("line"))
    return truncate_messages(df, 30).select("path", "line_no", "content", F.expr(_FLAG_TEXT).alias("flags"))


def flagship(i: Inputs) -> DataFrame:
    """Lines to events to a count per log, level and hour."""
    events = assemble(i.text_lines, r"^\[")
    return (
        events.select(
            "path",
            F.regexp_extract("content", _LEVEL, 1).alias("level"),
            F.substring(extract_timestamp("content", SEARCH_LOG_TIMESTAMPS), 1, 13).alias("hour"),
            "lines",
        )
        .groupBy("path", "level", "hour")
        .agg(F.count(F.lit(1)).alias("events"), F.sum("lines").cast("bigint").alias("lines"))
    )


query(
    "events_per_level_hour",
    cte("fx_text_lines")
    + r""", s as (select *, sum(case when regexp_matches(line, '^\[') then 1 else 0 end) over (partition by path order by line_no) as ev from fx_text_lines),
 e as (select path, ev, string_agg(line, chr(10) order by line_no) as content, count(*) as lines from s group by path, ev)
select path, regexp_extract(content, '\]\[(ERROR|WARN|INFO|DEBUG)\]', 1) as level,
 left(regexp_extract(content, '\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2},\d{3}'), 13) as hour,
 count(*) as events, cast(sum(lines) as bigint) as lines from e group by all""",
)(flagship)




@query(
    "container_cri",
    cte("fx_cri_lines")
    + """select path, line_no, split_part(line, ' ', 1) as ts, split_part(line, ' ', 2) as stream,
 split_part(line, ' ', 3) = 'P' as partial, split_part(line, ' ', 4) || ' ' || split_part(line, ' ', 5) as log from fx_cri_lines""",
)
def _(i: Inputs):
    return _container(parse_container(i.cri_lines, "cri"))


def _container(df: DataFrame) -> DataFrame:
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select("path", "line_no", ts.alias("ts"), "stream", "partial", "log")


_DOCKER_SQL = """select path, line_no, line::json->>'time' as ts, line::json->>'stream' as stream,
 not ends_with(line::json->>'log', chr(10)) as partial, line::json->>'log' as log from """


@query("container_docker", cte("fx_docker_lines") + _DOCKER_SQL + "fx_docker_lines")
def _(i: Inputs):
    return _container(parse_container(i.docker_lines, "docker"))


@query(
    "container_auto",
    cte("fx_docker_lines", "fx_cri_lines")
    + _DOCKER_SQL
    + """fx_docker_lines union all
 select path, line_no, split_part(line, ' ', 1), split_part(line, ' ', 2),
 split_part(line, ' ', 3) = 'P', split_part(line, ' ', 4) || ' ' || split_part(line, ' ', 5) from fx_cri_lines""",
)
def _(i: Inputs):
    return _container(parse_container(i.docker_lines.unionByName(i.cri_lines), "auto"))


def _partial_sql(view: str, parsed: str, keep: str) -> str:
    return (
        cte(view)
        + f""", p as (select path, line_no, {parsed} from {view}),
 g as (select *, coalesce(sum(case when partial then 0 else 1 end) over (partition by path order by line_no rows between unbounded preceding and 1 preceding), 0) as rec from p),
 e as (select path, min(line_no) as line_from, max(line_no) as line_to, arg_min(ts, line_no) as ts,
   arg_max(stream, line_no) as last_stream, string_agg(log, '' order by line_no) as content,
   bool_or(not partial) as closed from g group by path, rec)
select path, line_from, line_to, ts, last_stream, content from e where closed and {keep}"""
    )


_CRI_PARSED = """split_part(line, ' ', 1) as ts, split_part(line, ' ', 2) as stream, split_part(line, ' ', 3) = 'P' as partial,
   split_part(line, ' ', 4) || ' ' || split_part(line, ' ', 5) as log"""
_DOCKER_PARSED = """line::json->>'time' as ts, line::json->>'stream' as stream,
   not ends_with(line::json->>'log', chr(10)) as partial, line::json->>'log' as log"""


def _records(df: DataFrame) -> DataFrame:
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.select(
        "path", F.col("line_from").cast("bigint"), F.col("line_to").cast("bigint"), ts.alias("ts"), "last_stream", "content"
    )


@query("container_partial", _partial_sql("fx_cri_lines", _CRI_PARSED, "true"))
def _(i: Inputs):
    return _records(join_partials(i.cri_lines, "cri"))


@query("container_partial_docker", _partial_sql("fx_docker_lines", _DOCKER_PARSED, "true"))
def _(i: Inputs):
    return _records(join_partials(i.docker_lines, "docker"))


@query("container_stream", _partial_sql("fx_cri_lines", _CRI_PARSED, "last_stream = 'stderr'"))
def _(i: Inputs):
    return _records(filter_stream(join_partials(i.cri_lines, "auto"), "stderr"))
