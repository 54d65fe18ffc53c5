"""Directory and file names given by people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Fold ``.``, ``..`` and repeated slashes; an empty path is ``.``."""
    rooted = path.startswith("/")
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(
            (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)
        ).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    # `element_at` must not see an empty array.
    def safe_step(done: Column, part: Column) -> Column:
        return F.when(
            (part == "..") & (F.size(done) == 0), F.when(rooted, done).otherwise(F.array(part))
        ).otherwise(step(done, part))

    parts = F.array_join(F.aggregate(F.split(path, "/"), empty, safe_step), "/")
    return F.when(rooted, F.concat(F.lit("/"), parts)).otherwise(F.coalesce(F.nullif(parts, F.lit("")), F.lit(".")))


def expand_home(path: Column, home: str | None) -> Column:
    """Replace a leading ``~`` or ``~/``; the home directory is a setting."""
    if not home:
        return path
    return F.when(path == "~", F.lit(home)).when(
        path.startswith("~/"), F.concat(F.lit(home.rstrip("/") + "/"), F.substr(path, F.lit(3)))
    ).otherwise(path)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\x0b\f"))


def normalise_path(path: Column, home: str | None = None) -> Column:
    """Trimmed and cleaned; null when blank. Paths without a leading slash get backslashes."""
    trimmed = _trim(path)
    expanded = expand_home(trimmed, home)
    foreign = F.replace(expanded, F.lit("/"), F.lit("\\"))
    fixed = F.when(expanded.startswith("/"), clean_path(expanded)).otherwise(foreign)
    return F.when(trimmed != "", fixed)


def normalise_paths(
    df: DataFrame, keys: tuple[str, ...] = ("job",), raw: str = "raw", pos: str = "pos",
    fallback: str | None = None, home: str | None = None,
) -> DataFrame:
    """Cleaned, distinct paths per job in their first order.

    A job whose every entry is missing (null) uses the ``fallback`` column.
    """
    path = normalise_path(F.col(raw), home)
    rows = df.select(*keys, F.col(pos).alias("pos"), path.alias("path"))
    if fallback:
        spare = df.groupBy(*keys).agg(F.max(F.col(raw).isNotNull()).alias("_given"), F.max(fallback).alias("_spare"))
        spare = spare.filter(~F.col("_given")).select(
            *keys, F.lit(0).alias("pos"), normalise_path(F.col("_spare"), home).alias("path")
        )
        rows = rows.unionByName(spare)
    return rows.filter(F.col("path").isNotNull()).groupBy(*keys, "path").agg(F.min("pos").alias("pos"))


def safe_join(df: DataFrame, base: str = "logs_path", name: str = "file_name", home: str | None = None) -> DataFrame:
    """Add ``full_path``: the file under its directory, null when it would leave it."""
    folder = expand_home(_trim(F.col(base)), home)
    root = clean_path(folder)
    full = clean_path(F.concat(folder, F.lit("/"), _trim(F.col(name))))
    prefix = F.when(root == "/", F.lit("/")).otherwise(F.concat(root, F.lit("/")))
    inside = (full == root) | full.startswith(prefix)
    blank = (_trim(F.col(base)) == "") | (_trim(F.col(name)) == "")
    return df.withColumn("full_path", F.when(~blank & inside, full))
