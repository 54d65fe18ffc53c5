"""Web archives: writing captures as WARC records, reading them back, and one ordered index.

Writing: a task turns its pages into records and Spark's text writer puts them into files,
the record separator as its line separator, so any file system and committer will do. Of
equal payloads one is stored, as a response; the others are revisits that refer to it.

Reading: each file is walked record by record by its content lengths. Its captures, sorted by
URL key and time, are one run. The runs are dealt out by ranges of (key, time, record), and
within a range a loser tree merges all of them: the ranges one after the other are the
capture histories of all URLs in order. A URL with very many captures spans ranges.

Defined results: a null payload is stored as empty; a null URL has no target line and the
empty key; blanks and control characters in a URL are percent-encoded; a row without id is
stored under its digest and refers to the holder of an equal payload if there is one;
repeated rows are stored again; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import settled

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
#: Bytes of a file of average records, and rows merged by one task.
FILE_BYTES = 32 << 20
MERGE_ROWS = 200_000
#: Groups of equal payloads are broadcast up to so many, and joined beyond.
BROADCAST_GROUPS = 50_000
END = "\r\n\r\n"
ID = "urn:page:"
CAPTURE = (
    "surt string, captured string, record string, page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, intact boolean, file string, at long, length long"
)


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    place = "" if port is None or (parts.scheme, port) in (("http", 80), ("https", 443)) else f":{port}"
    query = f"?{parts.query}" if parts.query else ""
    return (",".join(reversed(host.split("."))) + place + ")" + (parts.path or "/") + query).lower()


def with_holders(pages: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_digest and holder: the largest id with an equal payload,
    where there are several rows of it and it is long enough."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn("payload_digest", F.sha1(payload))
    long_ones = rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
    groups = long_ones.groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    groups = settled(groups.select("payload_digest", "holder"))
    few = groups.count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, "payload_digest", "left")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def records(pages: DataFrame) -> DataFrame:
    """``value``, a record without its end, for rows (page_id, url, html, captured)."""
    rows = with_holders(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), F.col("captured").cast("timestamp")))
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    own = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none:"), F.col("payload_digest")))
    # Letters that would end the line or the record, each by its code.
    url = F.col("url")
    for code in range(0x21):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    body = F.when(revisit, F.lit("")).otherwise(F.coalesce("html", F.lit("")))
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), own, F.lit(">"))),
        _header("WARC-Target-URI", url),
        _header("WARC-Date", F.date_format(F.to_utc_timestamp("captured", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{ID}"), F.col("holder").cast("string"), F.lit(">")))),
        F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"),
        F.lit(END),
        body,
    )
    return rows.select(value.alias("value"))


def write_archives(pages: DataFrame, folder: str) -> None:
    """Writes the archive files of the pages (page_id, url, html, captured) to a folder."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    per_file = max(1, int(FILE_BYTES / (mean + 500)))
    records(pages).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)


def parse_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at offset {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield at, stop + 4 - at, headers, content[start:stop]
        at = stop + 4


def _page(reference: str | None) -> int | None:
    name = (reference or "").removeprefix(f"<{ID}").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all files, each file's sorted: one run per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [(f.split(" ")[0]) for f in CAPTURE.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
        kinds = [types[f.split(" ")[1]] for f in CAPTURE.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for at, length, head, payload in parse_records(content.as_py()):
                    named = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    stored = head["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if stored else named
                    rows.append(
                        (
                            url_key(head.get("WARC-Target-URI")), head.get("WARC-Date", ""), head["WARC-Record-ID"], _page(head["WARC-Record-ID"]),
                            head["WARC-Type"], _page(head.get("WARC-Refers-To")), len(payload) if stored else None, digest, digest == named,
                            path.as_py(), at, length,
                        )
                    )
                rows.sort(key=lambda r: r[:3])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(fields))], fields)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, CAPTURE)


def merge_runs(runs: list[list[tuple]]) -> Iterable[tuple]:
    """Merges sorted runs with a loser tree: each inner node keeps the run that lost there,
    so taking the least row and refilling costs one comparison per level."""
    runs = [r for r in runs if r]
    k = len(runs)
    if k < 2:
        yield from (runs[0] if runs else [])
        return
    ahead = [(r[0], i) for i, r in enumerate(runs)]  # next row of each run; ties to the earlier run
    place = [1] * k
    losers = [0] * k
    winners = [0] * k + list(range(k))  # leaves k to 2k - 1 are the runs
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if ahead[a] <= ahead[b] else (b, a)
    best, left = winners[1], sum(map(len, runs))
    while True:
        yield ahead[best][0]
        left -= 1
        if not left:
            return
        run = runs[best]
        ahead[best] = (run[place[best]], best) if place[best] < len(run) else None
        place[best] += 1
        node = (best + k) // 2
        while node:
            other = losers[node]
            if ahead[best] is None or ahead[other] is not None and ahead[other] < ahead[best]:
                best, losers[node] = other, best
            node //= 2


def merged_index(found: DataFrame) -> DataFrame:
    """Captures in global order: the rows of ``found`` plus part and place, their range and
    position in it."""
    found = settled(found)
    parts = max(1, -(-found.count() // MERGE_ROWS))
    fields = [f.name for f in found.schema.fields]
    order = [fields.index(c) for c in ("surt", "captured", "record", "file", "at")]
    schema = CAPTURE + ", part int, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        runs: dict[str, list[tuple]] = {}
        kinds = None
        for batch in batches:
            kinds = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[order[3]], []).append((tuple(row[i] for i in order), row))
        if kinds is None:
            return
        for rows in runs.values():
            if any(a[0] > b[0] for a, b in zip(rows, rows[1:])):  # blocks of a run may come in any order
                rows.sort(key=lambda r: r[0])
        part, done, chunk = TaskContext.get().partitionId(), 0, []

        def emit():
            columns = [pa.array([r[i] for r in chunk], kinds.field(i).type) for i in range(len(fields))]
            columns += [pa.array([part] * len(chunk), pa.int32()), pa.array(range(done, done + len(chunk)), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, [*fields, "part", "place"])

        keyed = ([(key, n, row) for n, (key, row) in enumerate(rows)] for rows in runs.values())
        for _, _, row in merge_runs([[(k, n, _Row(r)) for k, n, r in rows] for rows in keyed]):
            chunk.append(row)
            if len(chunk) == 10_000:
                yield emit()
                done, chunk = done + len(chunk), []
        yield emit()

    return found.repartitionByRange(parts, "surt", "captured", "record", "file", "at").mapInArrow(run, schema)


class _Row(tuple):
    """A row that never decides an order: fields may be null."""

    def __lt__(self, other):
        return False

    def __gt__(self, other):
        return False


def resolved(index: DataFrame) -> DataFrame:
    """The index with the payload size of revisits, read from the response they refer to."""
    index = settled(index)
    stored = index.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("stored_bytes"))
    rows = index.where("record_type = 'revisit'").join(stored, "refers_to", "left").withColumn("payload_bytes", F.col("stored_bytes"))
    return index.where("record_type = 'response'").unionByName(rows.select(*index.columns))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages' archives, reads them back and returns their merged index."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    return resolved(merged_index(captures(spark, folder)))


ORACLE = """
with d as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
h as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by payload_digest) else page_id end as holder from d)
select page_id, payload_bytes, payload_digest, case when page_id = holder then 'response' else 'revisit' end as record_type,
  case when page_id = holder then null else holder end as refers_to
from h
"""
