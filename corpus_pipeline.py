"""The corpus pipeline: each stage applies one operator to what the one before it kept.

``STAGES`` are (name, function); a function takes the session, the documents so far and the
folder of the tables, and returns the documents it keeps, with their columns. The last
stage returns the encoded documents.

Defined results, stage by stage. Null and empty texts and texts without a letter end in the
first. A null id or source passes every stage: no label and no language is learned from a row
without an id, near_dedup keeps every row without an id, mixing takes null as a source of its
own. Repeated rows get the same decisions; near_dedup keeps one row of an id and text. Further
columns pass all but the last stage, which returns doc_id, source, lang, n_tokens, ids and the
two checks. Ties go as the operators state. An empty table gives an empty one in every stage,
and without labels or languages to learn from nothing is toxic and every text is ``und``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtables.llm import bpe, langid, minhash, mixing, toxicity
from logtables.llm.common import free_name, table
from logtables.session import checkpoint_dir, configure

#: A text is toxic from this score on.
TOXIC_SCORE = 0.5
TOKENIZER = "word_bpe_49k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language: null, without letters, or made of letters and sequences that no
    learned language has. Texts in several languages have low scores and stay. A missing
    language is filled in with the one found."""
    model = langid.train(table(configure(spark), sf_dir, "documents"))
    names = tuple(free_name(docs, n) for n in ("found_lang", "found_score", "found_known"))
    found, _, known = names
    rows = langid.identify(docs, model, names)
    rows = rows.where((F.col(found) != langid.UNKNOWN) & (F.col(known) >= F.lit(model.floor if model else 0.0)))
    return rows.withColumn("lang", F.coalesce("lang", found)).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic texts."""
    model = toxicity.train(table(configure(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score, evidence = free_name(docs, "toxicity"), free_name(docs, "toxicity_evidence")
    rows = toxicity.score(docs, model, (score, evidence))
    return rows.where(F.col(score) < TOXIC_SCORE).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies."""
    configure(spark)
    return minhash.representatives(docs, words=minhash.WORDS, threshold=minhash.THRESHOLD)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source what its weight asks for: documents are left out or repeated."""
    configure(spark)
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the checks of the round trip."""
    configure(spark)
    rows = docs.select("doc_id", "source", "lang", "text")
    return bpe.encode(rows, public_tokenizers.path(TOKENIZER), with_ids=True).drop("text")


STAGES = [("language", language), ("toxicity", clean), ("near_dedup", deduplicate), ("mixing", mixed), ("bpe", encoded)]

#: Trained models and the random branching of the joins are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each one's documents written and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
