"""Physical lines into events.

All modes reduce to one question per line: which line does its event start at?
The answer is a running "last line where" (see ``ordered``), so a line is
shuffled once to its chunk and once, already combined, to its event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.match import matches
from ..functions.once import once
from .ordered import UNIT, by_chunk, walk, with_chunk

MAX_LINES = 500
MAX_BYTES = 10 * 1024 * 1024


def _held(condition: Column, negate: bool) -> Column:
    condition = F.coalesce(condition, F.lit(False))
    return ~condition if negate else condition


def assemble(
    lines: DataFrame,
    pattern: str,
    negate: bool = True,
    match: str = "after",
    flush_pattern: str | None = None,
    max_lines: int | None = MAX_LINES,
    max_bytes: int | None = MAX_BYTES,
    separator: str = "\n",
    skip_newline: bool = False,
    offsets: bool = False,
) -> DataFrame:
    """Join lines while ``pattern`` (XOR ``negate``) holds.

    With ``match="after"`` the pattern is tested on the line itself, with
    ``"before"`` on the line preceding it. ``flush_pattern`` names lines that
    are appended to the running event and close it. A fresh scan needs no
    numbering first, and ``offsets`` adds byte offsets to numbered lines, both
    in the same pass.
    """
    joins = _held(matches("line", pattern), negate)
    flush = None if flush_pattern is None else _held(matches("line", flush_pattern), False)
    return assemble_joined(lines, joins, match, flush, max_lines, max_bytes, separator, skip_newline, offsets=offsets)


def assemble_joined(
    lines: DataFrame,
    joins: Column,
    match: str = "after",
    flush: Column | None = None,
    max_lines: int | None = MAX_LINES,
    max_bytes: int | None = MAX_BYTES,
    separator: str = "\n",
    skip_newline: bool = False,
    aggregates: Sequence[Column] = (),
    offsets: bool = False,
) -> DataFrame:
    """As ``assemble`` with the conditions as columns, which may differ per file."""
    if match not in ("after", "before"):
        raise ValueError(f"match must be 'after' or 'before', not {match!r}")
    if flush is not None:
        keyed = _flush_starts(_numbered(lines), joins, match, flush)
    elif match == "after":
        keyed = _walked(lines, {"first": ~joins}, {}, offsets).withColumn("first", F.greatest("first", F.lit(1)))
    else:
        keyed = _walked(lines, {}, {"first": ~joins}, offsets).withColumn("first", F.col("first") + 1)
    return collect_events(keyed, max_lines, max_bytes, separator, skip_newline, aggregates)


def _is_scan(lines: DataFrame) -> bool:
    return "line_no" not in lines.columns and "mid" in lines.columns


def _walked(
    lines: DataFrame, upto: dict[str, Column], before: dict[str, Column], offsets: bool = False
) -> DataFrame:
    """Marks of numbered lines; a fresh scan gets its numbers and offsets in the same pass."""
    if not _is_scan(lines):
        if not offsets or "offset" in lines.columns:
            return walk(with_chunk(lines), upto=upto, before=before)
        size = F.col("bytes") if "bytes" in lines.columns else (F.octet_length("line") + 1).cast("bigint")
        rows = walk(with_chunk(lines), "line_no", {"offset": size}, upto, before)
        return rows.withColumn("end_offset", F.col("offset") + size)
    from ..sources.files import place

    return place(walk(lines, "mid", {"offset": F.col("bytes")}, upto, before, totals=True))


def _numbered(lines: DataFrame) -> DataFrame:
    if not _is_scan(lines):
        return with_chunk(lines)
    from ..sources.files import position_lines

    return position_lines(lines)


def _flush_starts(lines: DataFrame, joins: Column, match: str, flush: Column) -> DataFrame:
    """Event starts when closing lines exist.

    A closing line right after a closed event opens the next one instead, so in
    a run of flush lines every second one closes. Which one the run begins with
    depends on whether an event is open, that is on the run's distance from the
    last ordinary line. Inside a chunk this is known from its first ordinary line
    on. The flush lines before that are a function of what the chunk is entered
    with, and so are the chunk's last start and its last closing line: one summary
    row a chunk holds what that needs, the rows of a file are composed in order,
    and every line then knows the state it was entered with.
    """
    shared, zero = by_chunk(lines.withColumns({"_flush": flush, "_joins": joins}))
    inside = Window.partitionBy(*UNIT).orderBy("line_no")
    earlier = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    number = F.col("line_no")
    plain = F.max(F.when(~F.col("_flush"), number)).over(inside)
    previous = F.lag("_joins").over(inside)
    rows = shared.select("*", plain.alias("_plain"), previous.alias("_before"))

    def starts(joined: Column) -> Column:
        """An ordinary line that begins an event; ``joined``: does the line before join it?"""
        return ~F.col("_flush") & ~(F.col("_joins") if match == "after" else F.coalesce(joined, F.lit(True)))

    # What a chunk's own lines tell: closings and starts from its first ordinary line on.
    closes = F.col("_flush") & ((number - F.col("_plain")) % 2 == 1)
    chunks = rows.groupBy(*UNIT).agg(
        F.min("line_no").alias("_low"), F.sum(zero + 1).alias("_n"), F.min(F.when(~F.col("_flush"), number)).alias("_first"),
        F.max(F.col("_plain") + zero).alias("_last"), F.max(F.when(closes, number)).alias("_shut"), F.max(F.when(starts(F.col("_before")), number)).alias("_start"),
        F.max_by("_joins", "line_no").alias("_leaves"),
    )
    # What it is entered with: the last ordinary line so far, and whether the last line joins the next.
    chunks = chunks.select("*", F.coalesce(F.max("_last").over(earlier), F.lit(0)).alias("_in"), F.last("_leaves").over(earlier).alias("_enters"))
    lead_end = F.coalesce(F.col("_first") - 1, F.col("_low") + F.col("_n") - 1)
    odd = F.when(F.col("_in") == 0, F.lit(0)).otherwise(F.lit(1))
    lead_shut = lead_end - F.when((lead_end - F.col("_in")) % 2 == odd, F.lit(0)).otherwise(F.lit(1))
    shut = F.coalesce("_shut", F.when(lead_shut >= F.col("_low"), lead_shut))
    at_once = (F.col("_first") == F.col("_low")) & ~F.coalesce("_enters", F.lit(True)) & F.lit(match == "before")
    start = F.coalesce("_start", F.when(at_once, F.col("_low")))
    chunks = chunks.select(*UNIT, "_in", "_enters", shut.alias("_shut"), start.alias("_start"))
    chunks = chunks.select(
        *UNIT, "_in", "_enters", F.max("_shut").over(earlier).alias("_shut_in"), F.max("_start").over(earlier).alias("_start_in")
    )
    rows = shared.join(chunks, list(UNIT)).select("*", plain.alias("_plain"), previous.alias("_before"))
    in_run = number - F.coalesce("_plain", "_in")
    none_yet = F.coalesce("_plain", "_in") == 0
    rows = rows.withColumns(
        {
            "_closes": F.col("_flush") & F.when(none_yet, in_run % 2 == 0).otherwise(in_run % 2 == 1),
            "_opens": starts(F.coalesce("_before", "_enters")) & ((number > 1) | F.lit(match == "after")),
        }
    )
    opened = F.max(F.when(F.col("_opens"), number)).over(inside)
    closed = F.max(F.when(F.col("_closes"), number)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_open": F.greatest(opened, "_start_in"), "_closed": F.greatest(closed, "_shut_in")})
    first = F.greatest(F.coalesce("_open", F.lit(1)), F.coalesce("_closed", F.lit(0)) + 1, F.lit(1))
    kept = [*lines.columns, "_flush", "_joins", "_closes"]
    return rows.withColumn("first", first.cast("bigint")).select(*kept, "first")


def assemble_count(
    lines: DataFrame,
    count: int,
    max_lines: int | None = None,
    max_bytes: int | None = MAX_BYTES,
    separator: str = "\n",
    skip_newline: bool = False,
) -> DataFrame:
    """Join every ``count`` lines; a short last group is kept."""
    if count <= 0:
        raise ValueError("count must be positive")
    first = F.expr(f"((line_no - 1) div {int(count)}) * {int(count)} + 1")
    keyed = _numbered(lines).withColumn("first", first)
    return collect_events(keyed, max_lines or count, max_bytes, separator, skip_newline)


def assemble_while(
    lines: DataFrame,
    pattern: str,
    negate: bool = False,
    max_lines: int | None = MAX_LINES,
    max_bytes: int | None = MAX_BYTES,
    separator: str = "\n",
    skip_newline: bool = False,
) -> DataFrame:
    """Join runs of matching lines; every other line is its own event."""
    lines = lines.withColumn("_member", _held(matches("line", pattern), negate))
    keyed = _walked(lines, {"_alone": ~F.col("_member")}, {})
    keyed = keyed.withColumn("first", F.when(F.col("_member"), F.col("_alone") + 1).otherwise(F.col("line_no")))
    return collect_events(keyed, max_lines, max_bytes, separator, skip_newline)


def assemble_mode(lines: DataFrame, type: str = "pattern", **options) -> DataFrame:
    """Pick the assembly by name: ``pattern``, ``count`` or ``while_pattern``."""
    if type == "pattern":
        if not options.get("pattern"):
            raise ValueError("pattern mode needs a pattern")
        return assemble(lines, **options)
    if type == "count":
        if not options.get("count"):
            raise ValueError("count mode needs a line count")
        return assemble_count(lines, **options)
    if type == "while_pattern":
        if not options.get("pattern"):
            raise ValueError("while_pattern mode needs a pattern")
        return assemble_while(lines, **options)
    raise ValueError(f"unknown assembly type {type!r}")


def collect_events(
    keyed: DataFrame,
    max_lines: int | None,
    max_bytes: int | None,
    separator: str,
    skip_newline: bool,
    aggregates: Sequence[Column] = (),
    required: Sequence[str] = (),
) -> DataFrame:
    """One row per ``(path, first)``; lines without text only count.

    ``aggregates`` are carried along; groups where a ``required`` one is not
    true are left out.

    Only lines that can still be part of the stored text are collected: a
    position check bounds their number, a running size since the event's start
    bounds their bytes (inside the chunk, where their number is bounded too, so
    that an event spans two chunks at most). Counts cover every line, so the flags stay exact however long
    the event is.
    """
    glue = "" if skip_newline else separator
    size = "coalesce(octet_length(line), 0)"
    line_bytes = "bytes" if "bytes" in keyed.columns else f"{size} + 1"
    limited = bool(max_lines and max_lines > 0)
    # Without a glue an empty part adds nothing, so it need not be collected.
    keep = ["line is not null" if glue or limited else f"{size} > 0"]
    if limited:
        keep.append(f"line_no - first < {int(max_lines)}")
    bounded = bool(max_bytes and max_bytes > 0)
    if bounded:
        frame = "partition by path, chunk order by line_no rows between unbounded preceding and current row"
        keyed = keyed.selectExpr("*", f"sum({size}) over ({frame}) as _upto").selectExpr(
            "*", f"max(if(line_no = first, _upto - {size}, null)) over ({frame}) as _from"
        )
        if not limited:
            keyed = _with_carry(keyed)
        earlier = "0" if limited else "-_carry"
        keep.append(f"_upto - {size} - coalesce(_from, {earlier}) < {int(max_bytes)}")
    extra = list(aggregates)
    if "offset" in keyed.columns:
        extra.append(F.min("offset").alias("offset"))
    if "end_offset" in keyed.columns:
        extra.append(F.max("end_offset").alias("end_offset"))
    own = {
        "_kept": f"collect_list(if({' and '.join(keep)}, struct(line_no, line), null))",
        "lines": "sum(weight)" if "weight" in keyed.columns else "count(1)",
        "_size": "sum(full_size)" if "full_size" in keyed.columns else f"sum({size})",
        "bytes": f"sum({line_bytes})",
        "line_to": "max(line_no)",
    }
    events = keyed.groupBy("path", "first").agg(*[F.expr(v).alias(k) for k, v in own.items()], *extra)
    for name in required:
        events = events.filter(name)
    carried = [c for c in events.columns if c not in ("path", "first", *own, *required)]
    base = ["path", "first as line_from", "line_to", "lines", "bytes", "_size", *carried]
    events = events.selectExpr(*base, "transform(array_sort(_kept), x -> x.line) as _texts")
    return joined_texts(events, max_bytes, glue)


def joined_texts(events: DataFrame, max_bytes: int | None, glue: str) -> DataFrame:
    """``content`` and ``flags`` from an event's collected lines ``_texts`` and the size ``_size`` of all its lines."""
    kept = [c for c in events.columns if c != "_texts"]
    bounded = bool(max_bytes and max_bytes > 0)
    # Leading empty lines leave no trace: the glue comes only after some text.
    events = events.selectExpr(
        *kept,
        "_texts",
        "aggregate(_texts, 0L, (a, x) -> a + octet_length(x)) as _stored",
        "coalesce(array_position(transform(_texts, x -> x != ''), true), 0L) as _lead",
    )
    whole = "if(_lead = 0, '', array_join(slice(_texts, cast(_lead as int), size(_texts)), " + _sql_text(glue) + "))"
    events = events.selectExpr(*kept, "_texts", "_stored", f"{whole} as _whole")
    content, stored, taken = "_whole", "size(_texts)", "_stored"
    if bounded:
        cut = _byte_cut("_texts", int(max_bytes), len(glue.encode()))
        events = events.selectExpr(
            *kept, "_texts", "_stored", "_whole", f"if(octet_length(_whole) >= {int(max_bytes)}, {cut}, null) as _cut"
        )
        part = "make_valid_utf8(cast(substring(cast(_whole as binary), 1, cast(_cut.size as int)) as string))"
        content = f"if(_cut is null, _whole, {part})"
        stored, taken = "coalesce(_cut.stored, size(_texts))", "coalesce(_cut.taken, _stored)"
    flags = (
        f"filter(array(if(_size > {taken}, 'truncated', null), if({stored} > 1, 'multiline', null)), x -> x is not null)"
    )
    events = events.selectExpr(*kept, f"{content} as content", f"{flags} as flags").drop("_size")
    return once(events, "content", F.col("content"))


def _with_carry(keyed: DataFrame) -> DataFrame:
    """Add ``_carry``: the bytes that the event open at a chunk's beginning has so far.

    Made from one summary row per chunk: the running size of the file, less that
    at the last chunk with a start, plus what followed the start in that chunk.
    """
    chunks = keyed.groupBy("path", "chunk").agg(F.max("_upto").alias("_all"), F.max("_from").alias("_start"))
    earlier = "partition by path order by chunk rows between unbounded preceding and 1 preceding"
    chunks = chunks.selectExpr("*", "sum(_all) over (partition by path order by chunk) as _sum")
    chunks = chunks.selectExpr(
        "path",
        "chunk",
        f"coalesce(max(_sum) over ({earlier}) + last(if(_start is null, null, _all - _start - _sum), true) over ({earlier}), 0L) as _carry",
    )
    return keyed.join(chunks, ["path", "chunk"])


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _byte_cut(texts: str, max_bytes: int, glue: int) -> str:
    """Walk the (already bounded) lines of one event up to the byte limit."""
    base = f"(a.size + if(a.size > 0, {glue}, 0))"
    fits = f"(not a.full and {base} < {max_bytes})"
    part = f"least({max_bytes} - {base}, cast(octet_length(x) as bigint))"
    return (
        f"aggregate({texts}, named_struct('size', 0L, 'stored', 0, 'taken', 0L, 'full', false), (a, x) -> named_struct("
        f"'size', if({fits}, {base} + {part}, a.size), 'stored', if({fits}, a.stored + 1, a.stored), "
        f"'taken', if({fits}, a.taken + {part}, a.taken), 'full', not {fits}))"
    )


def truncate_messages(df: DataFrame, max_bytes: int, column: str = "content") -> DataFrame:
    """Hard byte limit on a record, flagged ``truncated``."""
    over = F.octet_length(column) > max_bytes
    flags = F.col("flags") if "flags" in df.columns else F.array().cast("array<string>")
    cut = F.make_valid_utf8(F.expr(f"cast(substring(cast(`{column}` as binary), 1, {int(max_bytes)}) as string)"))
    return df.withColumns(
        {
            "flags": F.when(over, F.concat(flags, F.array(F.lit("truncated")))).otherwise(flags),
            column: F.when(over, cut).otherwise(F.col(column)),
        }
    )
