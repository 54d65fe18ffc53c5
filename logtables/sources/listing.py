"""What files there are, empty ones included, with an identity that survives renames of others.

Spark's file sources leave out empty files, which a pass must see: a log cut to
nothing has to be read from its beginning when it grows again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DDL = "path string, size bigint, mtime timestamp, inode string, walked string, root string, turn int"
_FIELDS = pa.schema(
    [
        ("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC")),
        ("inode", pa.string()), ("walked", pa.string()), ("root", pa.string()), ("turn", pa.int32()),
    ]
)

#: Folder levels below a root that are walked by tasks of their own.
_DEPTH = 2
_PARTS = pa.schema([("root", pa.string()), ("folder", pa.string()), ("recursive", pa.bool_()), ("turn", pa.int32())])


def without_checksums(names: Sequence[str]) -> list[str]:
    """Names of a folder less the checksum files Hadoop keeps beside its own: ``.name.crc``."""
    there = set(names)
    return [n for n in names if not (n.startswith(".") and n.endswith(".crc") and n[1:-4] in there)]


def _below(root: str, folder: str) -> list[str]:
    """The folders right below one; links to folders are not followed."""
    if "://" not in root:
        try:
            with os.scandir(folder) as entries:
                return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
        except OSError:
            return []
    system, _ = pafs.FileSystem.from_uri(root)
    found = system.get_file_info(pafs.FileSelector(folder))
    return sorted(info.path for info in found if info.type == pafs.FileType.Directory)


def _parts(root: str, folder: str, depth: int) -> Iterator[tuple[str, bool]]:
    """Folders to be walked side by side; only the deepest with all that is below them."""
    if depth == 0:
        yield folder, True
        return
    yield folder, False
    for child in _below(root, folder):
        yield from _parts(root, child, depth - 1)


def _divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            root = row["root"]
            top = pafs.FileSystem.from_uri(root)[1] if "://" in root else root
            parts = list(_parts(root, top, _DEPTH)) if row["recursive"] else [(top, False)]
            yield pa.RecordBatch.from_pylist(
                [{"root": root, "folder": f, "recursive": deep, "turn": row["turn"]} for f, deep in parts], _PARTS
            )


def _local(folder: str, recursive: bool) -> Iterator[tuple]:
    """Regular files below a mounted folder; a link stands for its target."""
    for folder, folders, names in os.walk(folder):
        if not recursive:
            folders.clear()
        for name in without_checksums(names):
            walked = os.path.join(folder, name)
            try:
                path = os.path.realpath(walked) if os.path.islink(walked) else walked
                s = os.stat(path)
            except OSError:
                continue
            if os.path.isfile(path):
                yield path, s.st_size, s.st_mtime_ns // 1000, f"{s.st_dev}-{s.st_ino}", walked


def _remote(root: str, part: str, recursive: bool) -> Iterator[tuple]:
    system, inner = pafs.FileSystem.from_uri(root)
    prefix = root[: len(root) - len(inner.rstrip("/"))] if root.rstrip("/").endswith(inner.rstrip("/")) else ""
    for info in system.get_file_info(pafs.FileSelector(part, recursive=recursive)):
        if info.type == pafs.FileType.File:
            path = prefix + info.path
            yield path, info.size, (info.mtime_ns or 0) // 1000, "", path


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            root, folder, recursive = row["root"], row["folder"], row["recursive"]
            found = _remote(root, folder, recursive) if "://" in root else _local(folder, recursive)
            rows = []
            for entry in found:
                rows.append((*entry, row["root"], row["turn"]))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_FIELDS)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, _FIELDS)]
    return pa.RecordBatch.from_arrays(arrays, schema=_FIELDS)


def list_files(spark: SparkSession, roots: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """``path, name, size, mtime, inode, root, walked`` of every file below the roots, each once.

    The folders of a root's first two levels are walked side by side. A file
    reached more than once, by links or by nested roots, counts for the first
    root and under its real path.
    """
    names = [roots] if isinstance(roots, str) else list(dict.fromkeys(roots))
    asked = spark.createDataFrame(
        [(r, recursive, n) for n, r in enumerate(names)], "root string, recursive boolean, turn int"
    )
    parts = asked.repartition(len(names), "root").mapInArrow(_divide, "root string, folder string, recursive boolean, turn int")
    # The number is given: adaptive plans would merge folders for being small rows.
    tasks = max(len(names), spark.sparkContext.defaultParallelism)
    walked = parts.repartition(tasks, "root", "folder").mapInArrow(_list, _DDL)
    first = F.struct("turn", "walked")
    found = walked.groupBy("path").agg(
        F.min_by(F.struct("walked", "size", "mtime", "inode", "root"), first).alias("_f")
    )
    # The name that patterns see is the one in the folder, not the target's.
    name = F.element_at(F.split("_f.walked", "/"), -1)
    return found.select("path", name.alias("name"), "_f.size", "_f.mtime", "_f.inode", "_f.root", "_f.walked")
