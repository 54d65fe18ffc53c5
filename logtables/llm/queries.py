"""The named queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import bpe, dualtree, hilbert, itq, langid, licence, minhash, mixing, sharding, spelling, suffixes, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def fold(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string")) % parts


ORACLE_8 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
s as (
  select distinct doc_id, unnest(case when len(words) > 1 then [words[i] || ' ' || words[i + 1] for i in range(1, len(words))]
    when len(words) = 1 then words else []::varchar[] end) as shingle from w),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
l as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r as (select doc_id as id, doc_id as reached from documents union select r.id, l.b from r join l on r.reached = l.a),
c as (select id, min(reached) as component_id from r group by id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept
from documents join c on id = doc_id left join n using (doc_id)
"""


@query("op1_toxicity")
def op1(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


@query("op2_licences")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licence.scan(docs.select("doc_id", "text"), licence.train(docs), keep=["doc_id"])


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op4_bpe")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query("op5_warc", warc.ORACLE)
def op5(spark, sf_dir):
    # The table has no capture time: one page a second.
    pages = table(spark, sf_dir, "pages").withColumn("captured", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1577836800))
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_sharding", sharding.ORACLE)
def op6(spark, sf_dir):
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op7_mixing", mixing.ORACLE)
def op7(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_minhash", ORACLE_8)
def op8(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, threshold=0.8)


@query("op9_itq", itq.ORACLE)
def op9(spark, sf_dir):
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op10_hilbert", hilbert.ORACLE)
def op10(spark, sf_dir):
    return hilbert.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_dualtree", dualtree.ORACLE)
def op11(spark, sf_dir):
    return dualtree.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), 10)


@query("op12_spelling", spelling.ORACLE)
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_suffixes", suffixes.ORACLE)
def op13(spark, sf_dir):
    return suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), contents=False)
