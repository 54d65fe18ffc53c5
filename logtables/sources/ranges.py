"""Byte ranges of growing files.

A line belongs to the range that holds its terminator, so ranges of one file can
be read by different tasks, and a pass can start where the last one stopped even
in the middle of a line: the reader looks back for the line's beginning, once it has
found the end. Ranges are read in blocks, and of a line over the limit nothing is kept:
neither its length nor its range bounds what a task holds. A gzip file is one range, unpacked
while it is read.
"""

from __future__ import annotations

import gzip
import hashlib
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StringType, StructType

RANGE_BYTES = 64 * 1024 * 1024
_LOOK_BACK = 64 * 1024
#: Bytes read at once, and bytes of lines passed on together.
_BLOCK, _BATCH = 1 << 20, 8 << 20

#: First bytes that name a file where the file system has no identity for it.
HEAD_BYTES = 1024

#: Why a row is no line.
TOO_LONG, OPEN_END, REPLACED = "line too long", "open end", "replaced since it was listed"

LINE_SCHEMA = pa.schema(
    [("path", pa.string()), ("start", pa.int64()), ("offset", pa.int64()), ("end_offset", pa.int64()), ("line", pa.binary())]
)
LINE_DDL = "path string, start bigint, offset bigint, end_offset bigint, line binary"


def open_file(path: str):
    """A seekable file on any file system pyarrow knows, local paths included."""
    if "://" in path:
        system, inner = pafs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


def _line_start(f, position: int, limit: int | None = None) -> int | None:
    """Where the line that contains ``position`` begins; None if that is over ``limit`` bytes before."""
    asked = position
    while position > 0:
        if limit is not None and asked - position > limit:
            return None
        low = max(0, position - _LOOK_BACK)
        f.seek(low)
        found = f.read(position - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        position = low
    return 0


def complete_end(f, size: int) -> int:
    """End of the last terminated line within the first ``size`` bytes."""
    return _line_start(f, size)


def identity_of(path: str) -> str:
    """What names a file on a mounted folder, whatever it is called."""
    s = os.stat(path)
    return f"{s.st_dev}-{s.st_ino}"


def head_identity(f, count: int = HEAD_BYTES) -> str:
    """What names a file by its content: how many first bytes, and their hash."""
    f.seek(0)
    head = f.read(count)
    f.seek(0)
    return f"head:{len(head)}:{hashlib.sha256(head).hexdigest()}"


def is_same(f, path: str, identity: str) -> bool:
    """Is the open file the one that has the identity? A file named by its head may have grown."""
    if identity.startswith("head:"):
        return head_identity(f, int(identity.split(":")[1])) == identity
    return "://" in path or identity_of(path) == identity


def _batch(path: str, start: int, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    arrays = [pa.array([path] * len(rows), pa.string()), pa.array([start] * len(rows), pa.int64())]
    arrays += [pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, ["path", "start", "offset", "end_offset", "line", "reason"])


def read_lines(
    path: str, start: int, end: int, last: bool = False, limit: int | None = None, identity: str | None = None
) -> Iterator[pa.RecordBatch]:
    """Lines whose terminator lies in ``[start, end)`` of a file, in order, and with a reason what is no line.

    With ``last`` the range ends the file, and a rest without terminator is a line. A line over
    ``limit`` bytes is a row with its offsets and no text; its beginning is null if the range does
    not hold it, and then an open end of an earlier range (see ``refused_lines``). ``identity`` is
    that of the file the range was planned for: another file under its name is not read.
    """
    with open_file(path) as f:
        if identity and not is_same(f, path, identity):
            yield _batch(path, start, [(start, end, None, REPLACED)])
            return
        packed = path.endswith(".gz")
        source = gzip.GzipFile(fileobj=f) if packed else f
        if not packed:
            f.seek(start)
        at, begin = start, start if start == 0 else None  # begin: of the line at hand, None if before the range
        held: list[bytes] = []
        size, dropped, rows, weight = 0, False, [], 0

        def close(piece: bytes, stop: int) -> None:
            nonlocal begin, size, dropped, held, weight
            size += len(piece)
            text = None
            if begin is None and not dropped and (limit is None or size <= limit):
                begin = _line_start(f, start, None if limit is None else limit - size)
                if begin is not None:
                    f.seek(begin)
                    held.insert(0, f.read(start - begin))
                    size += start - begin
                f.seek(at + len(block))
            if begin is not None and not dropped and (limit is None or size <= limit):
                text = b"".join([*held, piece])
            rows.append((begin, stop, text, None if text is not None else TOO_LONG))
            weight += len(text or b"") + 64
            held, size, dropped, begin = [], 0, False, stop

        while packed or at < end:
            block = source.read(_BLOCK if packed else min(_BLOCK, end - at))
            if not block:
                break
            pieces = block.split(b"\n")
            place = at
            for n, piece in enumerate(pieces[:-1]):
                place += len(piece) + 1
                if n and (limit is None or len(piece) <= limit):  # the usual line, whole in the block
                    rows.append((begin, place, piece, None))
                    weight += len(piece) + 64
                    begin = place
                else:
                    close(piece, place)
                if weight > _BATCH:
                    yield _batch(path, start, rows)
                    rows, weight = [], 0
            rest = pieces[-1]
            size += len(rest)
            if limit is not None and size > limit:
                held, dropped = [], True
            elif rest:
                held.append(rest)
            at += len(block)
        block = b""
        if (last or packed) and (held or dropped):
            close(b"", at)
            # What stands there has no terminator, its end is the file's; a line over the end's own size.
            rows[-1] = (rows[-1][0], at, *rows[-1][2:])
        elif limit is not None and begin is not None and (held or dropped):
            rows.append((begin, at, None, OPEN_END))
        yield _batch(path, start, rows)


def read_range(path: str, start: int, end: int, last: bool = False) -> Iterator[pa.RecordBatch]:
    """``read_lines`` without a limit and without reasons."""
    for batch in read_lines(path, start, end, last):
        yield pa.RecordBatch.from_arrays(batch.columns[:5], schema=LINE_SCHEMA)


def read_ranges(
    files: DataFrame,
    range_bytes: int = RANGE_BYTES,
    carry: Sequence[str] = (),
    unfinished: bool = False,
    limit: int | None = None,
    reasons: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Lines of ``path`` between ``start_offset`` and ``end_offset``, whole files cut into ranges.

    Every range is its own row before the read, spread over all tasks; ``chunk``
    is the range's start, which orders the pieces of a file. ``carry`` names
    columns of the file that its lines keep. ``unfinished`` also takes a last line
    without terminator. With ``reasons`` there is a column ``reason``, null for lines; rows
    with a reason stand for lines over ``limit`` bytes and for ranges that could not be read, as the
    file is gone or, where ``carry`` has ``inode``, another one. Without it the first such range
    is an error. ``tasks`` saves counting the ranges.
    """
    packed = F.col("path").endswith(".gz")
    low = F.when(packed, F.lit(0)).otherwise(F.col("start_offset")).cast("bigint")
    step = F.when(packed, F.greatest("end_offset", F.lit(1))).otherwise(F.lit(range_bytes)).cast("bigint")
    starts = F.sequence(low, F.col("end_offset") - 1, step)
    pieces = files.filter(F.col("end_offset") > F.col("start_offset")).select(
        *carry, "path", F.explode(starts).alias("start"), F.col("end_offset").alias("_end")
    )
    end = F.when(packed, F.col("_end")).otherwise(F.least(F.col("start") + range_bytes, F.col("_end")))
    pieces = pieces.select(*carry, "path", "start", end.alias("end"), (F.lit(unfinished) & (end == F.col("_end"))).alias("last"))
    pieces = pieces.repartition(tasks) if tasks else spread(pieces)

    def rows_of(row: dict) -> Iterator[pa.RecordBatch]:
        try:
            yield from read_lines(row["path"], row["start"], row["end"], row["last"], limit, row.get("inode") or None if reasons else None)
        except OSError as error:
            if not reasons:
                raise
            yield _batch(row["path"], row["start"], [(row["start"], row["end"], None, f"cannot be read: {type(error).__name__}")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [batch.schema.field(c) for c in carry]
            for row in batch.to_pylist():
                for lines in rows_of(row):
                    if not reasons and limit is not None:
                        lines = lines.filter(pa.compute.is_null(lines.column("reason")))
                    same = [pa.array([row[f.name]] * len(lines), f.type) for f in kept]
                    yield pa.RecordBatch.from_arrays([*lines.columns, *same], names=[*lines.schema.names, *carry])

    fields = StructType.fromDDL(LINE_DDL).add("reason", StringType()).fields
    schema = StructType([*fields, *[pieces.schema[c] for c in carry]])
    return pieces.mapInArrow(read, schema).select(
        "path", F.col("start").alias("chunk"), "offset", "end_offset",
        F.col("line").cast("string").alias("line"),
        (F.col("end_offset") - F.col("offset")).alias("bytes"),
        *(["reason"] if reasons else []),
        *carry,
    )


def is_line(rows: DataFrame) -> Column:
    """Of rows with reasons: those that are lines."""
    return F.col("reason").isNull()


def refused_lines(rows: DataFrame) -> DataFrame:
    """``path, offset, bytes, reason``: lines over the limit, with the offset of their beginning
    even where it lies ranges before their end, and ranges that could not be read."""
    marked = rows.filter(~is_line(rows)).select("path", "chunk", "offset", "end_offset", "reason")
    opened = F.when(F.col("reason") == OPEN_END, F.col("offset"))
    earlier = Window.partitionBy("path").orderBy("chunk", "end_offset").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("offset", F.coalesce("offset", F.last(opened, ignorenulls=True).over(earlier)))
    marked = marked.filter(F.col("reason") != OPEN_END)
    return marked.select("path", "offset", (F.col("end_offset") - F.col("offset")).alias("bytes"), "reason")


def spread(rows: DataFrame, per_task: int = 2) -> DataFrame:
    """Small descriptors of large work over as many tasks as the work needs.

    The number is given, so that adaptive plans don't merge rows for being small.
    """
    context = rows.sparkSession.sparkContext
    count = rows.count()
    tasks = max(min(count, context.defaultParallelism), -(-count // per_task))
    return rows.repartition(max(1, min(tasks, 100_000)))


def count_lines(listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, total_rows`` of plain files: terminators, and an unterminated rest."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("bigint")))
    pieces = spread(listing.filter("size > 0").select("path", "size", starts.alias("start")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start"))):
                end, found, data = min(start + range_bytes, size), 0, b""
                with open_file(path) as f:
                    f.seek(start)
                    for at in range(start, end, 1 << 20):
                        data = f.read(min(1 << 20, end - at))
                        found += data.count(b"\n")
                counts.append(found + (end == size and data[-1:] not in (b"", b"\n")))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(counts, pa.int64())], ["path", "total_rows"])

    return pieces.mapInArrow(run, "path string, total_rows bigint").groupBy("path").agg(F.sum("total_rows").alias("total_rows"))


def count_terminators(path: str, start: int, end: int) -> int:
    """Line ends in a range of a plain file, or in a whole gzip file."""
    with open_file(path) as f:
        source = gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f
        if source is f:
            f.seek(start)
        found, left = 0, end - start
        while left > 0 or source is not f:
            block = source.read(_BLOCK if source is not f else min(_BLOCK, left))
            if not block:
                break
            found += block.count(b"\n")
            left -= len(block)
    return found


def _per_file(listing: DataFrame, name: str, sql_type: DataType, value, kind: pa.DataType) -> DataFrame:
    """Add a column computed from each file itself, in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["path", "size"]).to_pylist()
            column = pa.array([_or_none(value, r["path"], r["size"]) for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    return spread(listing, 64).mapInArrow(run, StructType([*listing.schema.fields]).add(name, sql_type))


def _or_none(value, path: str, size: int):
    """Null for a file that is gone or cannot be read."""
    try:
        return value(path, size)
    except OSError:
        return None


def _complete(path: str, size: int) -> int:
    if path.endswith(".gz"):  # as it is; its lines are counted unpacked
        return size
    with open_file(path) as f:
        return complete_end(f, size)


def with_complete_end(listing: DataFrame) -> DataFrame:
    """Add ``complete_end``: the end of the last terminated line; reads only file tails.
    Null for a file that cannot be read."""
    return _per_file(listing, "complete_end", LongType(), _complete, pa.int64())


def with_identity(listing: DataFrame, state: DataFrame) -> DataFrame:
    """``inode`` also for files whose file system has none: a hash of their first KiB.

    A file that still begins as its state says keeps the identity of the state, so a file that
    was shorter than a KiB may grow; ``head`` is the identity by what it begins with now, for the
    next state (null for other files and for such as were not opened). Files that have not
    changed since, by size and time, are not opened. Two files with the same first KiB are one.
    """
    kept = listing.columns
    old = state.select("path", F.col("inode").alias("_known"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    bare = F.coalesce(F.col("inode"), F.lit("")) == ""
    still = F.coalesce((F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime")), F.lit(False))
    rows = listing.join(old, "path", "left").select(*kept, "_known", (bare & ~still).alias("_open"), bare.alias("_bare"))
    rows = rows.repartition(4 * listing.sparkSession.sparkContext.defaultParallelism, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, heads = [], []
            for row in batch.select(["path", "inode", "_known", "_open", "_bare"]).to_pylist():
                name, head = row["_known"] if row["_bare"] else row["inode"], None
                if row["_open"]:
                    try:
                        with open_file(row["path"]) as f:
                            head = head_identity(f)
                            name = name if name and is_same(f, row["path"], name) else head
                    except OSError:  # gone since it was listed: the reader says so
                        name = name or ""
                names.append(name)
                heads.append(head)
            columns = {n: batch.column(n) for n in kept}
            columns |= {"inode": pa.array(names, pa.string()), "head": pa.array(heads, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, StructType([*listing.schema.fields]).add("head", StringType()))


def with_head(listing: DataFrame, count: int) -> DataFrame:
    """Add ``head``: the first bytes of each file."""

    def head(path: str, size: int) -> bytes:
        with open_file(path) as f:
            return f.read(count)

    return _per_file(listing, "head", BinaryType(), head, pa.binary())
