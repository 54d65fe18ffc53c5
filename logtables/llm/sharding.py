"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Within each source the rows are put in a seeded hash order and ranked; a row's fractional
rank is (rank + 1/2) / rows of its source. Sorted by that fraction, every stretch of the
result holds the sources in their overall proportions, so cutting it into stretches of
equal length gives shards that all match the mixture, with counts at most one apart.

The law is ``rows``. Equal texts are dealt like any others: a group of copies may hold a
third of all rows and cannot stay together in a shard of a 24th.

Defined results: a null text has size 8 and the checksum 0 of no bytes; null is a source of
its own; rows with equal ids, null included, are ordered by size and checksum; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, hash_key, running_total, settled, source_key, unit

SHARDS = 24
SEED = "shard"
#: Bytes a row needs besides its text.
ROW_BYTES = 8


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, src, place (0-based position in the
    interleaved order), shard and slot (position in the shard)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col("doc_id"),
        source_key(F.col("source")).alias("src"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        hash_key(seed, F.col("doc_id")).alias("key"),
    )
    rows = settled(rows)
    total = rows.count()
    cells = bucket_count(total)
    order = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    rows = running_total(rows, ["src"], unit(F.col("key")), order, F.lit(1), "nth", cells)
    counts = rows.groupBy("src").agg(F.count("*").alias("n"))
    rows = settled(rows.join(counts, "src").withColumn("fraction", (F.col("nth") + 0.5) / F.col("n")))
    order = [F.col("fraction"), F.col("src"), *order]
    rows = running_total(rows.withColumn("all", F.lit(0)), ["all"], F.col("fraction"), order, F.lit(1), "place", cells)
    # Shards 0 to extra - 1 hold one row more than the others.
    each, extra = divmod(total, shards)
    long_part = extra * (each + 1)
    rows = rows.withColumn(
        "shard",
        F.when(F.col("place") < long_part, F.expr(f"place div {each + 1}")).otherwise(F.expr(f"{extra} + (place - {long_part}L) div {max(each, 1)}")).cast("int"),
    )
    start = F.col("shard") * F.lit(each).cast("long") + F.least(F.col("shard"), F.lit(extra))
    return rows.withColumn("slot", F.col("place") - start).drop("all", "key", "nth", "n", "fraction")


# The checksum bit by bit gives its table of 256 steps; a text is folded byte by byte.
ORACLE = """
with recursive bits as (
  select i, i::bigint as c, 0 as n from range(256) r(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n + 1 from bits where n < 8),
steps as (select list(c order by i) as step from bits where n = 8),
d as (
  select doc_id, coalesce('a' || source, 'n') as src, octet_length(encode(coalesce(text, '')))::bigint + 8 as size,
    md5(concat_ws(':', 'shard', doc_id)) as key,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) as bytes from documents),
c as (
  select doc_id, src, size, key,
    xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32
  from d, steps),
r as (
  select *, (row_number() over (partition by src order by key, doc_id, size, text_crc32) - 1 + 0.5::double) / count(*) over (partition by src) as fraction from c),
p as (select *, row_number() over (order by fraction, src, key, doc_id, size, text_crc32) - 1 as place, count(*) over () as n from r),
s as (
  select *, n // 24 as each, n % 24 as extra,
    case when place < (n % 24) * (n // 24 + 1) then place // (n // 24 + 1) else (n % 24) + (place - (n % 24) * (n // 24 + 1)) // greatest(n // 24, 1) end as shard
  from p)
select doc_id, size, text_crc32::bigint as text_crc32, 'rows' as law, shard::int as shard,
  (place - shard * each - least(shard, extra))::bigint as slot, null::int as grown_shard from s
"""
