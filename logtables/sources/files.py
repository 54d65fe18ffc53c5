"""Log files as lines, with their place in the file."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import sum_before, walk, with_chunk

# Line terminator names and their characters.
TERMINATORS = {
    "auto": "\n",
    "line_feed": "\n",
    "vertical_tab": "\x0b",
    "form_feed": "\x0c",
    "carriage_return": "\r",
    "carriage_return_line_feed": "\r\n",
    "next_line": "\x85",
    "line_separator": "\u2028",
    "paragraph_separator": "\u2029",
    "null_terminator": "\x00",
}

# Codec names whose spelling differs from the JVM's.
_JVM_CHARSETS = {
    "": "UTF-8", "nop": "UTF-8", "plain": "UTF-8", "utf-8": "UTF-8", "utf8": "UTF-8", "unicode-1-1-utf-8": "UTF-8",
    "gbk": "GBK",
    "iso8859-6e": "ISO-8859-6", "iso8859-6i": "ISO-8859-6", "iso8859-8e": "ISO-8859-8", "iso8859-8i": "ISO-8859-8",
    "cp437": "IBM437", "cp850": "IBM850", "cp852": "IBM852", "cp855": "IBM855", "cp858": "IBM00858",
    "cp860": "IBM860", "cp862": "IBM862", "cp863": "IBM863", "cp865": "IBM865", "cp866": "IBM866",
    "ebcdic-037": "IBM037", "ebcdic-1040": "IBM01140", "ebcdic-1047": "IBM1047",
    "koi8r": "KOI8-R", "koi8u": "KOI8-U",
    "macintosh": "x-MacRoman", "macintosh-cyrillic": "x-MacCyrillic",
    "windows874": "x-windows-874",
    "utf-16be-bom": "UTF-16BE", "utf-16le-bom": "UTF-16LE",
}
# Codecs the JVM lacks; Python has them.
_PYTHON_CODECS = {"iso8859-10": "iso8859_10", "iso8859-14": "iso8859_14"}

#: Rows of one task that share a chunk: splits of a file are cut further, so
#: that an unsplittable file still spreads over many tasks after the scan.
_CHUNK_BITS = 18


def jvm_charset(name: str) -> str:
    """The JVM's name for a codec name."""
    key = name.lower()
    if key in _JVM_CHARSETS:
        return _JVM_CHARSETS[key]
    if key.startswith("iso8859-"):
        return "ISO-8859-" + key.removeprefix("iso8859-")
    if key.startswith("windows") and key[7:].isdigit():
        return "windows-" + key[7:]
    return name


def scan_lines(
    spark: SparkSession, roots: str | Sequence[str], line_sep: str = "\n", encoding: str | None = None
) -> DataFrame:
    """Every line of every file below ``roots``, gzip included.

    ``chunk`` orders the pieces of a file and ``mid`` the lines inside one. Both
    are fixed in the scan, before any shuffle. Columns: path, name, file_size,
    mtime, chunk, mid, line, bytes. ``bytes`` counts the separator too. Names
    that Spark's reader takes for hidden (a leading dot or underscore) are read
    as well, by byte ranges, where lines end in a line feed and are not decoded; the
    listing for them is walked while the lines are read, not before.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", line_sep)
    width = len(line_sep.encode())
    if encoding:
        charset = jvm_charset(encoding)
        reader = reader.option("encoding", charset)
        # The JVM's own encoder decides how wide the separator is on disk.
        width = len(line_sep) * 2 if charset.startswith("UTF-16") else width
    files = reader.text([roots] if isinstance(roots, str) else list(roots))
    meta = F.col("_metadata")
    mid = F.monotonically_increasing_id()
    rows = files.select(
        local_path(meta["file_path"]).alias("path"),
        meta["file_size"].alias("file_size"),
        meta["file_modification_time"].alias("mtime"),
        meta["file_block_start"].alias("_block"),
        mid.alias("mid"),
        F.col("value").alias("line"),
    )
    rows = rows.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "file_size", "mtime",
        F.struct(F.col("_block").alias("block"), F.shiftright("mid", _CHUNK_BITS).alias("part")).alias("chunk"),
        "mid", "line",
        (F.octet_length("line") + width).cast("bigint").alias("bytes"),
    )
    if line_sep != "\n" or encoding:
        return rows
    hidden = _hidden_files(spark, [roots] if isinstance(roots, str) else list(roots))
    return rows if hidden is None else rows.unionByName(_range_lines(hidden))


def _hidden_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame | None:
    """Plain files below local folders that Spark's file readers leave out by name."""
    from .listing import list_files

    folders = [r.removeprefix("file://") for r in roots if "://" not in r.removeprefix("file://") and not any(c in r for c in "*?[{")]
    if not folders:
        return None
    below = F.substring("walked", F.length("root") + 1, F.length("walked"))
    skipped = F.exists(
        F.filter(F.split(below, "/"), lambda part: part != ""),
        lambda part: part.startswith(".") | (part.startswith("_") & ~part.contains("=") & ~part.rlike("^_(common_)?metadata")),
    )
    return list_files(spark, folders).filter(skipped).drop("inode", "root", "walked")


def _range_lines(files: DataFrame) -> DataFrame:
    """Lines of listed files in the form of a scan; the last one may lack its terminator."""
    from .ranges import read_ranges

    whole = files.select("path", "name", F.col("size").alias("file_size"), "mtime", F.lit(0).cast("bigint").alias("start_offset"), F.col("size").alias("end_offset"))
    tasks = files.sparkSession.sparkContext.defaultParallelism
    lines = read_ranges(whole, carry=["name", "file_size", "mtime"], unfinished=True, tasks=tasks)
    chunk = F.struct(F.col("chunk").alias("block"), F.lit(0).cast("bigint").alias("part")).alias("chunk")
    order = F.row_number().over(Window.partitionBy("path", "chunk").orderBy("offset")).cast("bigint")
    return lines.select("path", "name", "file_size", "mtime", chunk, order.alias("mid"), "line", F.col("bytes"))


def local_path(uri: Column) -> Column:
    """Plain path of a ``file:`` URI; other URIs stay as they are."""
    plain = F.url_decode(F.replace(F.regexp_replace(uri, "^file:(?://)?", ""), F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file:"), plain).otherwise(uri)


def with_offsets(lines: DataFrame) -> DataFrame:
    """Byte offset where each numbered line starts and ends."""
    lines = with_chunk(lines)
    size = F.col("bytes") if "bytes" in lines.columns else (F.octet_length("line") + 1).cast("bigint")
    return sum_before(lines, {"offset": size}).withColumn("end_offset", F.col("offset") + size)


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """1-based line number of a fresh scan. Nothing is sorted: ``mid`` already counts."""
    return walk(lines, "mid")


def position_lines(lines: DataFrame, withhold: bool = False, final: bool = False) -> DataFrame:
    """Line numbers and true byte offsets of a fresh, unfiltered scan, in one pass."""
    return place(walk(lines, "mid", sums={"offset": F.col("bytes")}, totals=True), withhold, final)


def place(rows: DataFrame, withhold: bool = False, final: bool = False) -> DataFrame:
    """Turn summed line sizes into offsets on disk.

    The sum of a file's line sizes against its size on disk tells whether a byte
    order mark was skipped (offsets then move by three bytes) and whether the
    last line lacks its terminator. With ``withhold`` such a line is left out
    until it is finished; ``final`` says that the file will not grow. Sizes on
    disk mean nothing for gzip, where neither is done.
    """
    plain = ~F.col("path").endswith(".gz")
    gap = F.col("offset_total") - F.col("file_size")
    mark = F.when(plain & gap.isin(-3, -2), F.lit(3)).otherwise(F.lit(0))
    ends = F.col("offset") + F.col("bytes")
    open_tail = plain & gap.isin(1, -2) & (ends == F.col("offset_total"))
    end = ends + mark - F.when(open_tail, F.lit(1)).otherwise(F.lit(0))
    begin = F.when(F.col("offset") == 0, F.lit(0)).otherwise(F.col("offset") + mark)
    if withhold and not final:
        rows = rows.filter(~open_tail)
    kept = [c for c in rows.columns if c not in ("offset", "end_offset", "offset_total")]
    return rows.select(*kept, begin.cast("bigint").alias("offset"), end.cast("bigint").alias("end_offset"))


def decode_lines(lines: DataFrame, encoding: str = "plain", column: str = "line") -> DataFrame:
    """Text from raw bytes by codec name; bytes a codec lacks become U+FFFD.

    ``plain`` keeps the bytes as they are. ``utf-16-bom`` takes each value as a
    whole text with its own mark; for files see ``scan_utf16``. Needs the codec settings of
    ``session.configure``.
    """
    key = encoding.lower()
    raw = F.col(column).cast("binary")
    if key in ("", "nop", "plain"):
        return lines
    if key in _PYTHON_CODECS:
        return _decode_in_python(lines, _PYTHON_CODECS[key], column)
    if jvm_charset(key) == "UTF-8":
        return lines.withColumn(column, F.make_valid_utf8(F.expr(f"cast(cast(`{column}` as binary) as string)")))
    if key == "utf-16-bom":
        be = raw.substr(1, 2) == F.lit(bytearray(b"\xfe\xff"))
        le = raw.substr(1, 2) == F.lit(bytearray(b"\xff\xfe"))
        text = F.when(be, F.decode(raw, "UTF-16BE")).when(le, F.decode(raw, "UTF-16LE"))
        return lines.withColumn(column, text)
    return lines.withColumn(column, F.decode(raw, jvm_charset(key)))


def _decode_in_python(lines: DataFrame, codec: str, column: str) -> DataFrame:
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(codec, "replace"))

    return lines.withColumn(column, decode(F.col(column).cast("binary")))


def scan_utf16(spark: SparkSession, roots: str | Sequence[str], fallback: str | None = None) -> DataFrame:
    """Decoded lines of UTF-16 files whose mark tells the byte order.

    ``fallback`` is ``"be"`` or ``"le"`` for files without a mark; without it such
    files are left out. Only two bytes of each file are read to tell them apart.
    """
    from .listing import list_files
    from .ranges import with_head

    if fallback not in (None, "be", "le"):
        raise ValueError("fallback must be 'be', 'le' or None")
    head = F.col("head")
    order = F.when(head == F.lit(bytearray(b"\xfe\xff")), "be").when(head == F.lit(bytearray(b"\xff\xfe")), "le")
    heads = with_head(list_files(spark, roots), 2).select("path", F.coalesce(order, F.lit(fallback)).alias("order"))
    # The paths go to the reader, which keeps them on the driver in any case.
    paths: dict[str, list[str]] = {"be": [], "le": []}
    for row in heads.filter(F.col("order").isNotNull()).toLocalIterator():
        paths[row["order"]].append(row["path"])
    parts = [
        decode_lines(scan_lines(spark, found, encoding=f"utf-16{name}"), f"utf-16{name}")
        for name, found in paths.items() if found
    ]
    if not parts:
        raise FileNotFoundError("no UTF-16 file with a known byte order")
    return trim_bom(reduce(lambda x, y: x.unionByName(y), parts))


def split_lines(df: DataFrame, terminator: str = "auto", text: str = "text", keys: Sequence[str] = ("path",)) -> DataFrame:
    """Lines of texts held in a column, numbered from 1; an empty last part is no line."""
    if terminator not in TERMINATORS:
        raise ValueError(f"unknown line terminator {terminator!r}")
    end = TERMINATORS[terminator]
    parts = F.split(F.col(text), "\\Q" + end + "\\E", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rows = df.select(*keys, F.posexplode(parts).alias("_pos", "line"))
    rows = rows.select(*keys, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")
    return strip_newline(rows, "auto") if terminator == "auto" else rows


def strip_newline(lines: DataFrame, terminator: str = "auto", column: str = "line") -> DataFrame:
    """Remove one terminator from the end; ``auto`` also takes a preceding CR."""
    if terminator not in TERMINATORS:
        raise ValueError(f"unknown line terminator {terminator!r}")
    end = "\\r?\\n?\\z" if terminator == "auto" else "\\Q" + TERMINATORS[terminator] + "\\E\\z"
    return lines.withColumn(column, F.regexp_replace(column, end, ""))


def trim_bom(lines: DataFrame, column: str = "line") -> DataFrame:
    """Remove U+FEFF from both ends of every line."""
    return lines.withColumn(column, F.btrim(F.col(column), F.lit("\ufeff")))


def drop_overlong_lines(lines: DataFrame, max_bytes: int, column: str = "line") -> DataFrame:
    """Leave out lines over the limit; offsets must be known before."""
    return lines.filter(F.octet_length(column) <= max_bytes)
