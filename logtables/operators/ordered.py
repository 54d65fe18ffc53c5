"""Ordered computations per file without one task per file.

A lines table has ``path``, a dense 1-based ``line_no`` and a ``chunk`` that
grows with it. Every running value is built in two steps: a window inside each
``(path, chunk)``, and a carry made from one summary row per chunk. A file that
holds a third of all lines is therefore spread over as many tasks as it has
chunks; only the summary rows of a file meet in one window. Summaries and windows read
the same shuffle of the lines, so the input is evaluated once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines per chunk where the source does not bring chunks of its own.
CHUNK_LINES = 100_000

UNIT = ("path", "chunk")


def with_chunk(lines: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Add ``chunk`` unless the source (file splits, time buckets) gave one."""
    if "chunk" in lines.columns:
        return lines
    return lines.withColumn("chunk", F.expr(f"(line_no - 1) div {int(size)}"))


def _inside(order: Sequence[str | Column]):
    return Window.partitionBy(*UNIT).orderBy(*order)


def _earlier_chunks():
    return Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


#: Types that have no hash.
_UNHASHED = ("map", "variant")


def by_chunk(lines: DataFrame) -> tuple[DataFrame, Column]:
    """The lines dealt to their chunks, and a zero that looks at every column of a line.

    A summary that adds the zero to its values needs the same columns of the shuffle as the
    windows do, so the optimizer takes one shuffle for both instead of a narrower second one.
    Lines without path or chunk, which no window could place, are left out here for the same
    reason: a join would leave them out on one side only.
    """
    seen = [F.col(f"`{f.name}`") for f in lines.schema.fields if not any(t in f.dataType.simpleString() for t in _UNHASHED)]
    zero = F.xxhash64(*seen).bitwiseAND(F.lit(0).cast("bigint"))
    return lines.filter(F.col("path").isNotNull() & F.col("chunk").isNotNull()).repartition(*UNIT), zero


def number_lines(df: DataFrame, order: Sequence[str | Column], name: str = "line_no") -> DataFrame:
    """1-based position of each row per path; ``chunk`` must grow with ``order``."""
    shared, zero = by_chunk(df)
    carry = (
        shared.groupBy(*UNIT)
        .agg(F.sum(zero + 1).alias("_n"))
        .select(*UNIT, F.coalesce(F.sum("_n").over(_earlier_chunks()), F.lit(0)).alias("_base"))
    )
    local = shared.select("*", F.row_number().over(_inside(order)).alias("_local"))
    number = (F.col("_base") + F.col("_local")).cast("bigint").alias(name)
    return local.join(carry, list(UNIT)).select(*[c for c in df.columns if c != name], number)


def walk(
    lines: DataFrame,
    order: str = "line_no",
    sums: Mapping[str, Column] | None = None,
    upto: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    totals: bool = False,
) -> DataFrame:
    """All running values of a file in one pass.

    ``order`` must count up by one inside a chunk: ``line_no`` itself, or the
    row number of a fresh scan, from which ``line_no`` is then made. ``sums``
    add up the earlier lines (``totals`` also gives ``<name>_total`` over the
    file). ``upto`` and ``before`` give the last line number at which a
    condition held, the current line included or not, and 0 before that.

    The summary of a chunk is a plain aggregate without any sorting over the shuffle that
    the window reads as well.
    """
    sums, upto, before = sums or {}, upto or {}, before or {}
    columns = lines.columns
    # Conditions and values are worked out before the shuffle, once.
    lines = lines.withColumns({f"_v_{k}": v for k, v in [*sums.items(), *upto.items(), *before.items()]}) if sums or upto or before else lines
    sums = {k: F.col(f"_v_{k}") for k in sums}
    marks = {k: F.when(F.col(f"_v_{k}"), F.col(order)) for k in [*upto, *before]}
    lines, zero = by_chunk(lines)
    numbered = order == "line_no"
    earlier, file = _earlier_chunks(), Window.partitionBy("path")
    carry = lines.groupBy(*UNIT).agg(
        F.min(order).alias("_low"),
        F.sum(zero + 1).alias("_n"),
        *[F.sum(v + zero).alias(f"_s_{k}") for k, v in sums.items()],
        *[F.max(v + zero).alias(f"_m_{k}") for k, v in marks.items()],
    )
    shift = F.lit(0) if numbered else F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_low") + 1
    carry = carry.select(
        *UNIT,
        shift.cast("bigint").alias("_shift"),
        *[F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in sums],
        *([F.sum(f"_s_{k}").over(file).alias(f"{k}_total") for k in sums] if totals else []),
        *[F.col(f"_m_{k}") for k in marks],
    )
    if marks:
        placed = {f"_m_{k}": F.max(F.col(f"_m_{k}") + F.col("_shift")).over(earlier) for k in marks}
        carry = carry.select(*[placed[c].alias(c) if c in placed else F.col(c) for c in carry.columns])
    inside = _inside([order])
    with_self = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    without_self = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = lines.select(
        "*",
        *[F.sum(v).over(without_self).alias(k) for k, v in sums.items()],
        *[F.max(v).over(without_self if k in before else with_self).alias(k) for k, v in marks.items()],
    )
    joined = local.join(carry, list(UNIT))
    made = {k: (F.coalesce(F.col(k), F.lit(0)) + F.col(f"_s_{k}")).cast("bigint") for k in sums}
    for k in marks:
        here = F.col(k) + F.col("_shift")
        made[k] = F.coalesce(F.greatest(here, F.col(f"_m_{k}")), F.lit(0)).cast("bigint")
    if not numbered:
        made["line_no"] = (F.col(order) + F.col("_shift")).cast("bigint")
    kept = [c for c in columns if c not in made]
    extra = [f"{k}_total" for k in sums] if totals else []
    return joined.select(*kept, *extra, *[v.alias(k) for k, v in made.items()])


def sum_before(lines: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Per path, the sum of each value over all earlier lines (0 on the first)."""
    return walk(lines, sums=values)


def last_line_where(
    lines: DataFrame, upto: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per path, the last line number at which each condition held, else 0."""
    return walk(lines, upto=upto, before=before)
