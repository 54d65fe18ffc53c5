"""Container runtime logs: line formats, split records, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import parse_rfc3339
from .assemble import MAX_BYTES, collect_events
from .ordered import last_line_where, with_chunk

_DOCKER = "struct<time:string,stream:string,log:string,attrs:map<string,string>>"
FORMATS = ("auto", "docker", "json-file", "cri")
STREAMS = ("all", "stdout", "stderr")


def _docker(line: Column) -> Column:
    entry = F.from_json(line, _DOCKER)
    log = F.coalesce(entry["log"], F.lit(""))
    return F.struct(
        parse_rfc3339(entry["time"]).alias("ts"),
        F.coalesce(entry["stream"], F.lit("")).alias("stream"),
        log.alias("log"),
        (~log.endswith("\n")).alias("partial"),
        entry["attrs"].alias("attrs"),
    )


def _cri(line: Column, tagged: bool = True) -> Column:
    parts = F.split(line, " ", 4 if tagged else 3)
    last = 3 if tagged else 2
    text = F.get(parts, F.lit(last))
    partial = F.array_contains(F.split(F.get(parts, F.lit(2)), ":"), "P") if tagged else F.lit(False)
    cut = F.when(partial, F.regexp_replace(text, "\n\\z", "")).otherwise(text)
    return F.struct(
        F.when(text.isNotNull(), parse_rfc3339(F.get(parts, F.lit(0)))).alias("ts"),
        F.get(parts, F.lit(1)).alias("stream"),
        cut.alias("log"),
        partial.alias("partial"),
        F.lit(None).cast("map<string,string>").alias("attrs"),
    )


def parse_container(
    lines: DataFrame, format: str = "auto", tagged: bool = True, keep_bad: bool = False
) -> DataFrame:
    """Add ``ts, stream, log, partial, attrs``; lines that do not parse are dropped.

    ``auto`` reads a line starting with ``{`` as the JSON format and any other
    as the space-separated one. ``keep_bad`` keeps bad lines with ``log`` null,
    which ``join_partials`` needs to see every line number.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    line = F.col("line")
    if format == "cri":
        parsed = _cri(line, tagged)
    elif format in ("docker", "json-file"):
        parsed = _docker(line)
    else:
        parsed = F.when(line.startswith("{"), _docker(line)).otherwise(_cri(line, tagged))
    df = lines.withColumn("_p", parsed)
    good = F.col("_p.ts").isNotNull()
    names = ("ts", "stream", "log", "partial", "attrs")
    df = df.withColumns({n: F.when(good, F.col(f"_p.{n}")) for n in names}).drop("_p")
    return df if keep_bad else df.filter(F.col("ts").isNotNull())


def join_partials(lines: DataFrame, format: str = "auto", max_bytes: int | None = MAX_BYTES) -> DataFrame:
    """Glue split records up to their first full line.

    The first part's time is kept, ``last_stream`` is that of the last part. A
    record still open at the end of the input is not emitted.
    """
    parsed = parse_container(with_chunk(lines), format, keep_bad=True)
    full = F.coalesce(~F.col("partial"), F.lit(False))
    keyed = last_line_where(parsed.withColumn("_full", full), before={"first": F.col("_full")})
    keyed = keyed.withColumns(
        {"first": F.col("first") + 1, "bytes": F.octet_length("line") + 1, "line": F.col("log")}
    )
    when_good = F.when(F.col("ts").isNotNull(), F.col("line_no"))
    aggregates = [
        F.max("_full").alias("closed"),
        F.min_by("ts", when_good).alias("ts"),
        F.min_by("stream", when_good).alias("stream"),
        F.max_by("stream", when_good).alias("last_stream"),
        F.min_by("attrs", when_good).alias("attrs"),
    ]
    events = collect_events(keyed, None, max_bytes, "", True, aggregates, ["closed"])
    return events.withColumn("flags", F.array_remove("flags", "multiline"))


def filter_stream(records: DataFrame, stream: str = "all") -> DataFrame:
    """Keep one stream, judged on the last part of a record."""
    if stream not in STREAMS:
        raise ValueError(f"stream must be one of {STREAMS}")
    if stream == "all":
        return records
    judged = "last_stream" if "last_stream" in records.columns else "stream"
    return records.filter(F.col(judged) == stream)
