"""What the plans of metric documents and merged JSON do once, and odd documents."""

import gzip
from datetime import datetime

from pyspark.sql import functions as F

from logtables.operators import metrics as m
from logtables.plans import catalog, fixtures, pass_queries
from logtables.plans.metric_queries import SHARES, node_docs
from logtables.sinks import sink_metrics


def _inputs(spark, folder):
    spark.createDataFrame(
        [(n // 3, n % 5, n % 2, n % 3 + 1, 5.0, 10.0, "N", "F") for n in range(30)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string",
    ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(n, f"s{n}", n) for n in range(2)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")
    events = [(n, datetime(2024, 1, 1, n % 24), n % 9, "view", 1.5, '{"a":1}') for n in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_node_documents_are_built_after_their_only_grouping(spark, tmp_path):
    docs = node_docs(fixtures.Inputs(spark, _inputs(spark, tmp_path)))
    plan = _plan(docs)
    assert plan.count("Aggregate [") == 1
    # Nothing of a document is there before its node is met.
    assert "max_unsafe" not in plan[plan.index("Join ") :]


def test_node_documents_shuffle_their_rows_once(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many nodes
    try:
        docs = node_docs(fixtures.Inputs(spark, _inputs(spark, tmp_path)))
        plan = docs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One of the rows and one of the nodes; nothing is sorted or shuffled behind the grouping.
    assert plan.count("Exchange hashpartitioning") == 2 and "Sort [" not in plan
    assert plan.index("ShuffledHashJoin") < plan.index("Aggregate(") < plan.index("Exchange hashpartitioning")


def test_node_documents_of_many_listings_and_odd_keys(spark, tmp_path):
    """One node in more listings than it has shares, rows without a listing or a node, a node that is there twice."""
    lines = [(n * 1000, 1, s, 1, 5.0, 10.0, "N", "F") for n in range(3 * SHARES) for s in (1, 2)]
    lines += [(None, 1, 1, 1, 5.0, 10.0, "N", "F"), (7, 1, None, 1, 5.0, 10.0, "N", "F"), (7, 1, 3, 1, 5.0, 10.0, "N", "F")]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_returnflag string, l_linestatus string",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "s1", 1), (2, "s2", 2), (2, "s2", 2), (None, "s", 3), (4, "s4", 4)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    inputs = fixtures.Inputs(spark, str(tmp_path))
    rows = [(r.node_id, r.snapshot) for r in m.explode_nodes(node_docs(inputs)).select("node_id", "snapshot").collect()]
    want = [(node, n) for n in range(3 * SHARES) for node in ("n1", "n2", "n2")] + [("n1", None)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    # The documents written as text say what the variants say.
    said = lambda docs: sorted((str(r.snapshot), str(r.t)) for r in docs.select("snapshot", "t").collect())
    texts = node_docs(inputs, F.to_json).withColumn("t", F.to_json(F.parse_json("doc")))
    assert said(texts) == said(node_docs(inputs).withColumn("t", F.to_json("doc")))


def _kept(spark, name):
    """Names of the files that Spark holds in its own folders."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(n).getName() for n in range(files.length()) if files.apply(n).getName().startswith(name)}


def _staged_under(monkeypatch, folder):
    monkeypatch.setattr(pass_queries, "staging", lambda i, what: f"{folder}/{what}")


def _text(files):
    return sum(len(gzip.decompress(f.read_bytes())) for f in files)


def test_snapshots_are_staged_compressed(spark, tmp_path, monkeypatch):
    _staged_under(monkeypatch, tmp_path)
    rows = catalog.QUERIES["read_snapshots"](spark, _inputs(spark, tmp_path)).collect()
    assert sorted((r.node_id, r.name, r.host, r.kind) for r in rows) == [("n0", "s0", "10.0.0.0", "node_stats"), ("n1", "s1", "10.0.1.1", "node_stats")]
    files = list((tmp_path / "snapshots").glob("part-*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    assert sum(f.stat().st_size for f in files) * 2 < _text(files)


def test_sinks_take_events_made_once_and_leave_no_shuffle(spark, tmp_path, monkeypatch):
    _staged_under(monkeypatch, tmp_path)
    before = _kept(spark, "shuffle_")
    rows = catalog.QUERIES["sink_metrics"](spark, _inputs(spark, tmp_path))
    assert _kept(spark, "shuffle_") <= before
    want = [("node_stats", node, sink) for node in ("n0", "n1") for sink in ("folder", "function")]
    assert sorted((r["name"], r.node_id, r.sink) for r in rows.collect()) == want
    files = list((tmp_path / "metrics").glob("name=node_stats/part-*"))
    assert files and all(f.name.endswith(".txt.gz") for f in files)


def test_a_folder_sink_keeps_its_text_and_drops_its_shuffle(spark, tmp_path):
    events = spark.range(40).select((F.col("id") % 2).alias("k"), F.lit("x" * 500).alias("v")).repartition(3, "k").select(
        F.struct(F.concat(F.lit("m"), "k").alias("name")).alias("metadata"), F.struct("v").alias("fields"), F.lit("t").alias("timestamp")
    )
    switch = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(switch, None)
    for codec, ending in (("none", ".txt"), ("gzip", ".txt.gz")):
        folder, before = str(tmp_path / codec), _kept(spark, "shuffle_")
        sink_metrics(events, folder, **({} if codec == "none" else {"compression": codec}))
        assert _kept(spark, "shuffle_") <= before and spark.conf.get(switch, None) == was
        rows = spark.read.text(folder).groupBy("name", "value").count().collect()
        assert {(r["name"], r["value"]): r["count"] for r in rows} == {
            (f"m{k}", f'{{"metadata":{{"name":"m{k}"}},"fields":{{"v":"{"x" * 500}"}},"timestamp":"t"}}'): 20 for k in range(2)
        }
        assert all(f.name.endswith(ending) for f in (tmp_path / codec).glob("name=*/part-*"))


def test_a_folder_sink_of_few_and_many_names(spark, tmp_path):
    def names(count):
        return spark.range(0, 200, 1, 2).select(
            F.struct(F.concat(F.lit("m"), F.col("id") % count).alias("name")).alias("metadata"), F.struct("id").alias("fields"), F.lit("t").alias("timestamp")
        )

    for count in (3, 20):
        folder = str(tmp_path / str(count))
        sink_metrics(names(count), folder)
        assert spark.read.text(folder).select("name", "value").distinct().count() == 200
        # A file for each name and task, whether the rows were sorted or not.
        assert len(list((tmp_path / str(count)).glob("name=*/part-*"))) == 2 * count


def test_node_and_shard_objects_are_taken_out_once(spark, tmp_path):
    docs = node_docs(fixtures.Inputs(spark, _inputs(spark, tmp_path)))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    nodes = m.explode_nodes(docs)
    assert "cast(" not in _plan(nodes)
    assert "cast(_copy" not in _plan(m.explode_shards(nodes))


def test_merge_json_reads_its_events_once(spark, tmp_path):
    plan = _plan(catalog.QUERIES["merge_json"](spark, _inputs(spark, tmp_path)))
    assert plan.count("from_json") + plan.count("jsontostructs") <= 2


def test_odd_members_of_node_documents(spark):
    doc = """{"nodes":{"a":{"host":"h","indices":{"shards":{"i":[{"0":{"n":1},"1":2},3,null],"j":4,"k":[]},"segments":5}},
      "b":6,"c":null,"d":{"indices":[1]},"e":{"indices":{"docs":1}},"f":{"indices":{"shards":7}}}}"""
    docs = spark.createDataFrame([(doc,), ('{"nodes":[]}',), ("[]",)], "t string").select(
        F.lit("c").alias("cluster_id"), F.lit("u").alias("cluster_uuid"), F.parse_json("t").alias("doc")
    )
    nodes = m.explode_nodes(docs)
    counts = {r["node_id"]: (r["indices_count"], r["shard_count"]) for r in m.node_shard_summary(nodes).collect()}
    assert counts == {"a": (3, 2), "d": (None, None), "e": (0, 0), "f": (0, 0)}
    shards = m.explode_shards(nodes)
    assert sorted((r["node_id"], r["index_name"], r["shard"]) for r in shards.collect()) == [("a", "i", "0"), ("a", "i", "1")]
    assert [r["metadata"]["labels"]["shard"] for r in m.shard_event(shards).collect()] == ["0"]
    pruned = {r["node_id"]: r["n"] for r in m.prune_node(m.node_shard_summary(nodes)).select("node_id", F.to_json(F.to_variant_object("node")).alias("n")).collect()}
    assert pruned["a"] == '{"host":"h","indices":{"segments":5},"shard_info":{"indices_count":3,"shard_count":2}}'
    assert pruned["d"] == '{"indices":[1],"shard_info":{}}'
