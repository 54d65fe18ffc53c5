"""The pipeline's stages on a messy table, and its run against the stages' own results."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from logtables.llm import common

from .data import DOC_SCHEMA, messy_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messy(spark):
    return messy_documents(spark)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage(spark, messy, name):
    docs, rows = messy
    stage = dict(pipeline.STAGES)[name]
    # The stages' models learn from the tables of the folder, the stage works on ``docs``.
    out = stage(spark, docs, SF)
    ids = sorted(str(r.doc_id) for r in out.select("doc_id").collect())
    every = sorted(str(r[0]) for r in rows)
    if name == "bpe":
        assert ids == every
        assert all(len(r.ids) == r.n_tokens for r in out.collect())
    else:
        assert out.columns == docs.columns
        if name == "mixing":
            assert set(ids) <= set(every)
        elif name == "near_dedup":
            assert "10" in ids and "11" not in ids and ids.count("30") == 1 and {"1", "2", "3"} <= set(ids)
        elif name == "language":
            assert not {"1", "2", "3", "4"} & set(ids) and {"5", "10", "30", "40"} <= set(ids)
        else:
            assert ids == every
    assert stage(spark, spark.createDataFrame([], DOC_SCHEMA), SF).count() == 0


def test_run(spark):
    rows = pipeline.run(spark, SF)
    found = {r.doc_id: r.n_tokens for r in rows.select("doc_id", "n_tokens").collect()}
    docs = pipeline.table(spark, SF, "documents")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert {r.doc_id: r.n_tokens for r in docs.select("doc_id", "n_tokens").collect()} == found and found


def test_settled_leaves_no_shuffle_files(spark):
    """Rounds of checkpoints do not pile up the shuffles of the rounds before."""
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    before = files()
    rows = common.settled(spark.range(0, 1000, 1, 8).groupBy((F.col("id") % 100).alias("k")).count())
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert rows.count() == 100 and spark.conf.get(common.CLEANUP, None) != "true"
