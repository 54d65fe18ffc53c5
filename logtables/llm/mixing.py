"""Mixing sources to target weights: hash order, prefix sums of words, exact budgets.

Every row gets a hash-random key. Within a source the rows lie in key order, dealt into
key ranges; the words before a row are the words of the earlier ranges plus those before
it in its own. A source's budget is cut out of that order, through as many whole epochs as
it takes and then up to the exact word.

Defined results: a null or blank text has size 0 and nothing is taken of it; null is a
source of its own, last; rows with equal ids, ids null included, share a key and are taken
in order of size; an empty table gives no rows; other columns are ignored by ``mix`` and
kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_count, free_name, hash_key, running_total, settled, source_key, unit

#: Weights given to the sources in code point order, again and again.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words.
MAX_EPOCHS = 3
SEED = "mix"
WORDS = r"[^\x20\x09-\x0D]+"
#: A table of sources of at most so many rows is broadcast, a larger one joined.
BROADCAST_SOURCES = 2000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target words of each source (src, source_size) -> (src, source_size, target).

    Sharing the excess again and again ends where every source below its limit gets the
    same words per weight. In order of limit per weight the limited sources come first, so
    running sums tell which they are. The rows are sources, not documents.
    """
    ranks = W.orderBy("src")
    cases = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ranks) - 1) % len(weights) + 1)
    rows = sizes.withColumn("w", cases.cast("double")).withColumn("most", F.col("source_size") * float(max_epochs))
    every = W.orderBy(F.col("most") / F.col("w"), "src")
    earlier = every.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).cast("double").alias("all_size"),
        F.sum("w").over(whole).alias("all_w"),
        F.coalesce(F.sum("most").over(earlier), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0.0)).alias("w_before"),
    )
    rows = rows.withColumn("full", F.expr("most * (all_w - w_before) <= w * (all_size - most_before)"))
    rows = rows.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0.0)).alias("full_size"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(whole), F.lit(0.0)).alias("full_w"),
    )
    target = F.when(F.col("full"), F.col("most")).otherwise(F.expr("w * ((all_size - full_size) / (all_w - full_w))"))
    return rows.select("src", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the source's
    epochs (whole passes) and left (words of the last, partial pass), the row's key and
    words_before in that pass."""
    rows = settled(
        docs.select(
            F.col("doc_id"),
            source_key(F.col("source")).alias("src"),
            word_count(F.col("text")).alias("size"),
            hash_key(seed, F.col("doc_id")).alias("key"),
        )
    )
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    targets = targets.withColumn("budget", F.floor("target").cast("long"))
    targets = targets.withColumn("epochs", F.expr("if(source_size = 0, 0L, budget div source_size)"))
    targets = targets.withColumn("left", F.expr("budget - epochs * source_size"))
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    rows = running_total(rows, ["src"], unit(F.col("key")), order, F.col("size"), "words_before", bucket_count(rows.count()))
    taken = F.expr("epochs * size + greatest(0L, least(size, left - words_before))")
    return rows.join(targets, "src").withColumn("taken", taken).drop("budget")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, whole: each once per whole epoch of its source, and once
    more if its key comes before the source's cut. The document on the cut comes if half
    of its words or more lie before it."""
    plan = mix(docs, weights, max_epochs, seed)
    extra = F.expr("left > 0 and 2 * (left - words_before) >= size")
    cuts = settled(plan.groupBy("src").agg(F.max("epochs").alias("epochs"), F.max(F.when(extra, F.col("key"))).alias("cut")))
    src, key = free_name(docs, "mix_src"), free_name(docs, "mix_key")
    epochs, cut = free_name(docs, "mix_epochs"), free_name(docs, "mix_cut")
    cuts = cuts.select(F.col("src").alias(src), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    rows = docs.withColumn(src, source_key(F.col("source"))).withColumn(key, hash_key(seed, F.col("doc_id"))).join(cuts, src)
    copies = F.col(epochs) + F.coalesce((F.col(key) <= F.col(cut)).cast("long"), F.lit(0))
    one = free_name(docs, "mix_copy")
    rows = rows.withColumn(one, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
with d as (
  select doc_id, coalesce('a' || source, 'n') as src, md5(concat_ws(':', 'mix', doc_id)) as key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
s as (select src, sum(size)::bigint as source_size from d group by src),
w as (select *, [5, 2, 1][(row_number() over (order by src) - 1) % 3 + 1]::double as w, source_size * 3.0::double as most from s),
p as (
  select *, (sum(source_size) over ())::double as all_size, sum(w) over () as all_w,
    coalesce(sum(most) over e, 0) as most_before, coalesce(sum(w) over e, 0) as w_before
  from w window e as (order by most / w, src rows between unbounded preceding and 1 preceding)),
f as (select *, most * (all_w - w_before) <= w * (all_size - most_before) as is_full from p),
t as (
  select src, source_size, case when is_full then most else
    w * ((all_size - coalesce(sum(most) filter (where is_full) over (), 0)) / (all_w - coalesce(sum(w) filter (where is_full) over (), 0))) end as target
  from f),
b as (select *, floor(target)::bigint as budget, case when source_size = 0 then 0 else floor(target)::bigint // source_size end as epochs from t),
r as (
  select d.*, source_size, target, epochs, budget - epochs * source_size as remaining,
    coalesce(sum(size) over (partition by d.src order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as words_before
  from d join b using (src))
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, remaining - words_before)))::bigint as taken from r
"""
