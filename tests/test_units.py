"""Single operators on small inputs."""

from __future__ import annotations

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from logtables import jobs
from logtables.functions.fields import as_text, lookup, parse_object, remove_fields
from logtables.functions.match import contains_text, describe, matches
from logtables.functions.regex import to_java
from logtables.functions.timestamps import format_timestamp, parse_timestamp, timestamp_layout
from logtables.operators import discovery, metrics, serving
from logtables.operators.container import filter_stream, join_partials, parse_container
from logtables.operators.jsonlog import decode_json, merge_json
from logtables.operators.state import advance_state, classify_changes, resolve_links
from logtables.sources.catalogue import LogPattern, search_log_patterns
from logtables.sources.files import split_lines, strip_newline, trim_bom
from logtables.sources.paths import normalise_paths, safe_join

# Log-shaped patterns and texts of our own; DuckDB's RE2 engine says what matches.
LOG_TEXTS = [
    "", "\t", "[2031-05-06T07:08:09] GET /metrics 200", "GET /metrics", "took=14ms shard[3] gc.old", "gcXold", "WARN: low disk", "x WARN",
    "ERROR", "ERROR: a|b", "Größe überschritten", "größe", "a\nERROR", "{\"k\": [1, 2]}", "path=C:\\logs\\a.log", "$total + 1", "31.12.2030 ok", "retry?", "retries",
]
LOG_PATTERNS = [
    "", "shard\\[3\\]", "gc\\.old", "gc.old", "^WARN", "(?:^WARN|disk$)", "^(?:ERROR|WARN)", "ERROR|retries", "(|GET)", "\\$total \\+", "retr(?:y\\?|ies)",
    "^\\[\\d{4}-\\d{2}-\\d{2}T", "^\\d{2}\\.\\d{2}\\.\\d{4}", "überschritten$", "(?i)GRÖSSE|größe", "^\\s+$", "^\\{.*\\}$", "C:\\\\logs", ".*ms.*", "^.*[0-9]{3}$",
]
KINDS = {"gc\\.old": "contains", "^WARN": "prefix", "^(?:ERROR|WARN)": "any_prefix", "ERROR|retries": "any_contains", "": "any"}


@pytest.mark.parametrize("exact", [False, True])
def test_matchers(spark, exact):
    df = spark.createDataFrame(list(enumerate(LOG_TEXTS)), "i int, t string")
    ask = "select regexp_full_match(?, ?)" if exact else "select regexp_matches(?, ?)"
    for pattern in LOG_PATTERNS:
        if not exact and pattern in KINDS:
            assert describe(pattern)[0] == KINDS[pattern], pattern
        got = {r.i for r in df.filter(matches("t", pattern, exact)).collect()}
        want = {i for i, t in enumerate(LOG_TEXTS) if duckdb.execute(ask, [t, pattern]).fetchone()[0]}
        assert got == want, (pattern, [LOG_TEXTS[i] for i in got ^ want])



def test_regex_dialect(spark):
    df = spark.createDataFrame([("a\x85b", "x\x0by")], "nel string, vt string")
    row = df.select(F.col("nel").rlike(to_java("a.b")), F.col("vt").rlike(to_java(r"x\sy"))).first()
    assert tuple(row) == (True, False)
    for bad in ("(?=x)", "(?<!x)y", r"(a)\1"):
        with pytest.raises(ValueError):
            to_java(bad)
    assert to_java("[[:digit:]]") == "(?d)[0-9]" and to_java("(?P<n>x)") == "(?d)(?<n>x)"


def test_literal(spark):
    df = spark.createDataFrame([("a.b",), ("",)], "t string")
    assert [r[0] for r in df.select(contains_text("t", ".")).collect()] == [True, False]
    assert [r[0] for r in df.select(contains_text("t", "")).collect()] == [False, True]


def test_json_strictness(spark):
    texts = ['{"a":[1]}', ' {"a":"]"}\n', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[{"b":2}', "[1]", "1", "", "null", "{'a':1}", '{"a":NaN}', '{"a":1']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    good = {r["i"] for r in df.filter(parse_object("t").isNotNull()).collect()}
    assert good == {0, 1}
    lenient = {r["i"] for r in decode_json(df, column="t").filter(F.col("json").isNotNull()).collect()}
    assert {0, 1, 2, 3} <= lenient


def test_remove_and_lookup(spark):
    text = '{"a.b":1,"a":{"b":2,"c":{"d":3,"e":4}},"x":{"y":"z"},"n":null,"big":12345678901234567890}'
    df = spark.createDataFrame([(text,)], "t string").withColumn("m", parse_object("t"))
    left = df.select(F.to_json(remove_fields("m", ["a.b", "a.c.d", "x.y.z", "big"]))).first()[0]
    assert json.loads(left) == {"a": {"c": {"e": 4}}, "x": {"y": "z"}, "n": None}
    row = df.select(lookup("m", "a.b").cast("int"), as_text(lookup("m", "x.y")), lookup("m", "big").cast("string")).first()
    assert tuple(row) == (1, "z", "12345678901234567890")


def test_merge_json_expands(spark):
    df = spark.createDataFrame([('{"a.b":1,"a":{"c":2},"k":"new","@timestamp":"2024-01-01T00:00:00Z"}',)], "t string")
    df = df.withColumn("json", parse_object("t")).withColumn("fields", parse_object(F.lit('{"k":"old","json":1}')))
    row = merge_json(df, overwrite_keys=True, expand_keys=True).select(F.to_json("fields"), F.unix_seconds("event_time")).first()
    assert json.loads(row[0]) == {"a": {"b": 1, "c": 2}, "k": "new"} and row[1] == 1704067200
    assert json.loads(merge_json(df).select(F.to_json("fields")).first()[0])["k"] == "old"
    assert "json" in merge_json(df, keys_under_root=False).columns


def test_timestamps(spark):
    df = spark.createDataFrame([("2024-03-10T00:05:06.120000Z",)], "t string").withColumn("ts", parse_timestamp("t"))

    def f(pattern, zone="UTC"):
        return df.select(format_timestamp("ts", pattern, zone)).first()[0]

    assert f("h hh k kk K a e") == "1 01 1 01 0 AM 0"
    assert f("S SS SSSSSSSSSS f ff ffff fffffffff n") == "1 12 1200000000 1 12 120 120 120000000"
    assert f("y yy yyyyy x w D E EEEE M MM MMM MMMM") == "2024 24 02024 2024 10 70 Sun Sunday 3 03 Mar March"
    assert f("'it''s' z", "Asia/Kathmandu") == "its +05:45"
    assert f("HH:mm z", "America/New_York") == "19:05 -05:00"
    assert f(timestamp_layout("nanosecond")) == "2024-03-10T00:05:06.120Z"
    with pytest.raises(ValueError):
        f("Q")
    with pytest.raises(ValueError):
        f("'open")
    bad = spark.createDataFrame([("2024-03-10T00:05:06Z",), ("2024-03-10 00:05:06.123Z",), ("2024-13-10T00:05:06.123Z",)], "t string")
    assert bad.filter(parse_timestamp("t").isNotNull()).count() == 0


def test_paths(spark):
    rows = [(1, 0, "/var/log/es"), (1, 1, "/var/log/es/gc"), (1, 2, "/var/log/es"), (2, 0, "~"), (2, 1, "~/foo/bar"), (2, 2, "\t /a/../../b/ "), (3, 0, "C:/logs/246"), (4, 0, " ")]
    df = spark.createDataFrame(rows, "job int, pos int, raw string")
    got = sorted((r["job"], r["pos"], r["path"]) for r in normalise_paths(df, home="/home/u").collect())
    assert got == [(1, 0, "/var/log/es"), (1, 1, "/var/log/es/gc"), (2, 0, "/home/u"), (2, 1, "/home/u/foo/bar"), (2, 2, "/b"), (3, 0, "C:\\logs\\246")]
    pairs = [("/var/log/es", "server.log"), ("/var/log/es", "../server.log"), ("/var/log/es", "../es2/x"), ("/", "a"), ("", "x"), ("logs", "../x"), ("logs", "a/./b")]
    joined = safe_join(spark.createDataFrame(pairs, "logs_path string, file_name string")).collect()
    assert [r["full_path"] for r in joined] == ["/var/log/es/server.log", None, None, "/a", None, None, "logs/a/b"]


def test_lines_of_columns(spark):
    df = spark.createDataFrame([("f", "a\r\nb\n\nc\r\n")], "path string, text string")
    assert [r["line"] for r in split_lines(df).collect()] == ["a", "b", "", "c"]
    assert [r["line"] for r in split_lines(df, "line_feed").collect()] == ["a\r", "b", "", "c\r"]
    assert [r["line"] for r in split_lines(df, "carriage_return").collect()] == ["a", "\nb\n\nc", "\n"]
    one = spark.createDataFrame([("\ufeff\ufeffx\ufeffy\ufeff",)], "line string")
    assert trim_bom(one).first()[0] == "x\ufeffy"
    ends = spark.createDataFrame([("a\r\n",), ("a\n\n",), ("a",), ("a\r",)], "line string")
    assert [r[0] for r in strip_newline(ends, "line_feed").collect()] == ["a\r", "a\n", "a", "a\r"]
    for call in (split_lines, strip_newline):
        with pytest.raises(ValueError):
            call(df, "tab")


def test_containers(spark):
    lines = [
        "2017-09-12T22:32:21.212861448Z stdout F whole line", "2017-09-12T22:32:22Z stderr P:X part ", "broken",
        "2017-09-12T22:32:23+02:00 stdout F rest", "2017-09-12T22:32:21Z stdout",
        '{"log":"x\\n","stream":"stdout"}', '{"log":"docker ","stream":"stdout","time":"2024-01-01T00:00:00Z","attrs":{"k":"v"}}',
        '{"log":"","stream":"stdout","time":"2024-01-01T00:00:01Z"}', '{"log":"end\\n","stream":"stderr","time":"2024-01-01T00:00:02Z"}',
        "2017-09-12T22:32:22Z stderr P never closed",
    ]
    df = spark.createDataFrame([("f", i + 1, i // 2, x) for i, x in enumerate(lines)], "path string, line_no bigint, chunk bigint, line string")
    assert parse_container(df).count() == 7
    got = sorted((r["line_from"], r["line_to"], r["content"], r["stream"], r["last_stream"], r["flags"]) for r in join_partials(df).collect())
    assert got == [
        (1, 1, "whole line", "stdout", "stdout", []), (2, 4, "part rest", "stderr", "stdout", []),
        (5, 9, "docker end\n", "stdout", "stderr", []),
    ]
    assert {r["content"] for r in filter_stream(join_partials(df), "stderr").collect()} == {"docker end\n"}
    cut = join_partials(df, max_bytes=4).filter("line_from = 2").first()
    assert (cut["content"], cut["flags"]) == ("part", ["truncated"])
    with pytest.raises(ValueError):
        parse_container(df, "syslog")


def test_changes(spark):
    ddl = "path string, size bigint, mtime int, inode string"
    now = spark.createDataFrame([("new", 1, 1, "a"), ("same", 5, 1, "b"), ("grown", 9, 2, "c"), ("touched", 5, 2, "d"), ("shrunk", 3, 2, "e"), ("swapped", 9, 1, "x")], ddl)
    old = spark.createDataFrame([(p, 5, 1, i, 5) for p, i in (("same", "b"), ("grown", "c"), ("touched", "d"), ("shrunk", "e"), ("swapped", "f"), ("gone", "g"))], ddl + ", resume_offset bigint")
    changes = classify_changes(now, old)
    got = {r["path"]: (r["op"], r["start_offset"]) for r in changes.collect()}
    assert got == {"new": ("create", 0), "grown": ("write", 5), "touched": ("truncate", 0), "shrunk": ("truncate", 0), "swapped": ("create", 0)}
    state = advance_state(old, changes.withColumn("resume_offset", F.col("size")))
    assert {r["path"]: r["resume_offset"] for r in state.collect()} == {"new": 1, "same": 5, "grown": 9, "touched": 5, "shrunk": 3, "swapped": 9, "gone": 5}
    listing = spark.createDataFrame([("l", 0, 0, "l", "real"), ("real", 7, 7, "r", None), ("bad", 0, 0, "z", "nowhere")], ddl + ", link_target string")
    got = {(r["path"], r["size"]) for r in resolve_links(listing, now.limit(0).unionByName(listing.select("path", "size", "mtime", "inode"))).collect()}
    assert got == {("real", 7)}


def test_catalogue():
    names = [(p.name, p.type) for p in search_log_patterns()]
    assert names == [("server", "json"), ("index_search_slowlog", "json"), ("index_indexing_slowlog", "json"), ("deprecation", "json"), ("audit", "json"), ("gc", "multiline")]
    everything = search_log_patterns({k: {"text": True} for k in ("server", "search_slow", "indexing_slow", "deprecation", "audit")})
    assert len(everything) == 11 and everything[-1].pattern == ".*.log$"
    with pytest.raises(ValueError):
        LogPattern("x", "xml")


def test_discovery(spark):
    lines = [
        "  sl  local_address rem_address   st", "   0: 0100007F:23F0 00000000:0000 0A 00000000:00000000 00:00000000 00000000  1000        0 1 1",
        "12345: 0000000000000000FFFF00000200000A:23F1 0000:0000 0A 0:0 00:0 00000000 1000 0 2", "1: 0100007F:23F2 0:0 01 0:0 00:0 0 1000 0 3",
        "2: 0100007F:23F0 0:0 06 0:0 00:0 0 7 0 3",
    ]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "host_id int, seq int, line string")
    got = [(r["uid"], r["ip"], r["port"]) for r in discovery.parse_sockets(df).orderBy("seq").collect()]
    assert got == [(1000, "127.0.0.1", 9200), (1000, "10.0.0.2", 9201), (7, "127.0.0.1", 9200)]
    bound = spark.createDataFrame([("[::1]:9200",), ("h:",), ("h:x",), ("none",)], "address string")
    assert [(r["ip"], r["port"]) for r in discovery.parse_bound_addresses(bound).collect()] == [("[::1]", 9200), ("h", 0), ("h", 0)]
    urls = discovery.endpoint_candidates(spark.createDataFrame([("::1", 9200)], "ip string, port int")).orderBy("attempt").collect()
    assert [u["url"] for u in urls] == ["http://[::1]:9200", "https://[::1]:9200"]
    engines = ["java -cp x org.elasticsearch.bootstrap.Elasticsearch", "java org.opensearch.bootstrap.OpenSearch -d", "python", "elasticsearch"]
    procs = spark.createDataFrame([(e,) for e in engines], "cmdline string")
    assert discovery.filter_engine_processes(procs).count() == 2


def test_metric_jobs(spark):
    doc = {"nodes": {"n1": {"name": "a", "ip": "1.1.1.1", "host": "h", "ingest": {}, "indices": {"segments": {"count": 1, "max_unsafe_auto_id_timestamp": 3}, "shards": {"i": [{"0": {"segments": {"count": 1}}}, {"1": {"docs": {}}}], "empty": []}}}, "n2": {"name": "b", "indices": {}}, "n3": {"name": "c"}, "bad": 1}}
    docs = spark.createDataFrame([("cid", "", "t0", json.dumps(doc))], "cluster_id string, cluster_uuid string, timestamp string, raw string")
    docs = docs.withColumn("doc", F.parse_json("raw")).drop("raw")
    rows = []
    jobs.node_stats(docs, lambda df: rows.extend(df.selectExpr("metadata.name", "metadata.labels", "to_json(fields) as f", "timestamp").collect()))
    nodes = {r["labels"]["node_id"]: json.loads(r["f"])["elasticsearch"]["node_stats"] for r in rows if r["name"] == "node_stats"}
    assert nodes["n1"]["shard_info"] == {"indices_count": 2, "shard_count": 2}
    assert nodes["n1"]["indices"] == {"segments": {"count": 1}} and "ingest" not in nodes["n1"]
    assert nodes["n2"]["shard_info"] == {"indices_count": 0, "shard_count": 0} and nodes["n3"]["shard_info"] == {}
    assert set(nodes) == {"n1", "n2", "n3"}
    shards = {r["labels"]["shard"]: (r["labels"], json.loads(r["f"])["elasticsearch"]["shard_stats"]) for r in rows if r["name"] == "shard_stats"}
    assert shards["0"][1] == {"segments": {"count": 1, "max_unsafe_auto_id_timestamp": None}} and shards["1"][1] == {"docs": {}}
    assert shards["0"][0]["index_id"] == ":i" and shards["0"][0]["shard_id"] == "n1:i:0" and "cluster_uuid" not in shards["0"][0]

    listing = spark.createDataFrame([("n1", "i", "0", "p", "STARTED"), ("n1", "i", "0", "r", "STARTED"), ("n1", "j", "0", "p", "UNASSIGNED")], "node_id string, index_name string, shard string, shard_type string, state string")
    rows.clear()
    jobs.node_stats(docs, lambda df: rows.extend(df.selectExpr("metadata.labels", "to_json(fields) as f").collect()), level="", cat_shards=listing)
    infos = {r["labels"]["node_id"]: json.loads(r["f"])["elasticsearch"]["node_stats"]["shard_info"] for r in rows}
    assert infos["n1"]["shard_count"] == 1 and infos["n1"]["replicas_count"] == 1 and infos["n1"]["indices_count"] == 1
    assert [s["shard_type"] for s in infos["n1"]["shards"]] == ["p", "r"] and infos["n2"] is None

    stats = spark.createDataFrame([("i", "u-i", "cid", "u", "t0", 5)], "index_name string, index_uuid string, cluster_id string, cluster_uuid string, timestamp string, total_docs bigint")
    rows.clear()
    jobs.index_stats(stats, lambda df: rows.extend(df.selectExpr("metadata.labels", "to_json(fields) as f").collect()), listing, all_index_stats=True, sums=("total_docs",))
    assert {r["labels"]["index_id"] for r in rows} == {"cid:i", "_all"}
    for job, name in ((jobs.cluster_health, "cluster_health"), (jobs.cluster_stats, "cluster_stats")):
        rows.clear()
        job(docs, lambda df: rows.extend(df.select("metadata.name", "metadata.labels").collect()), {"k": "v"})
        assert rows[0]["name"] == name and rows[0]["labels"] == {"cluster_id": "cid", "cluster_uuid": "", "k": "v"}


def test_pages_and_listing(spark, tmp_path):
    (tmp_path / "a.log").write_text("l1\n\nl3\nl4")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "no.log").write_text("x\n")
    files, errors = serving.list_log_files(spark, [str(tmp_path), str(tmp_path / "gone")])
    assert {(r["name"], r["total_rows"], r["size_in_bytes"]) for r in files.collect()} == {("a.log", 4, 9), ("empty.log", 0, 0)}
    assert [e["logs_path"] for e in errors] == [str(tmp_path / "gone")]
    from logtables.sources.files import scan_lines

    lines = scan_lines(spark, str(tmp_path))

    def page(start, count):
        rows = serving.read_page(lines, str(tmp_path / "a.log"), start, count).collect()
        return [(r["line_no"], r["content"], r["end_offset"], r["eof"]) for r in rows]

    assert page(0, 2) == [(1, "l1", 3, False), (2, "", 4, False)]
    assert page(3, 2) == [(3, "l3", 7, False), (4, "l4", 9, False)]
    assert page(3, 5) == [(3, "l3", 7, True), (4, "l4", 9, True)]


def test_index_toggles(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "pri_docs int, total_docs int, index_info int, shard_info int")
    assert metrics.index_fields(df, primary_stats=False).columns == []
    assert metrics.index_fields(df, primary_stats=False, total_stats=True).columns == ["total_docs"]


def test_landed_documents_feed_the_metric_operators(spark, tmp_path):
    """From files of documents to events, without renaming anything on the way."""
    from logtables.sources.snapshots import read_snapshots

    shard = {"routing": {"node": "n1", "primary": True, "state": "STARTED"}, "docs": {"count": 3}}
    docs = {
        "node_stats": {"cluster_name": "c", "nodes": {"n1": {"host": "h", "indices": {"shards": {"logs": [{"0": shard}]}}}}},
        "index_stats": {"_all": {"total": {"docs": 9}}, "indices": {"a": {"uuid": "u1", "primaries": {"docs": 4}, "total": {"docs": 8}}, "b": {"uuid": "u2"}, "x": 1}},
        "cat_shards": [{"index": "a", "shard": "0", "prirep": "p", "state": "STARTED", "id": "n1"}, {"index": "a", "shard": "1", "prirep": "r", "state": "STARTED", "id": "n2"}, 5],
        "indices": [{"index": "a", "uuid": "u1", "health": "green", "status": "open", "pri": "2", "rep": "1", "docs.count": "8"}],
    }
    for kind, doc in docs.items():
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "d.json").write_text(json.dumps(doc) + "\n")
    read = lambda kind: read_snapshots(spark, str(tmp_path / kind), kind, cluster_uuid="uuid-1")
    nodes = metrics.explode_nodes(read("node_stats"))
    assert [(r.cluster_id, r.cluster_uuid, r.node_id) for r in nodes.collect()] == [("c", "uuid-1", "n1")]
    assert metrics.shard_event(metrics.explode_shards(nodes)).count() >= 1
    stats = metrics.explode_indices(read("index_stats"))
    rows = {r.index_name: r for r in stats.selectExpr("index_name", "index_uuid", "cast(total as string) as total", "cast(primaries as string) as primaries").collect()}
    assert {n: (r.index_uuid, r.total) for n, r in rows.items()} == {"_all": ("_all", '{"docs":9}'), "a": ("u1", '{"docs":8}'), "b": ("u2", None)}
    listing, info = metrics.explode_shard_listing(read("cat_shards")), metrics.explode_index_list(read("indices"))
    # The documents of one moment are one snapshot; here they were landed one by one.
    same = lambda df: df.drop("cluster_id", "cluster_uuid", "timestamp").withColumn("snapshot", F.lit("s"))
    events = {r.index_name: r for r in metrics.index_events(same(stats), same(listing), same(info)).selectExpr("index_name", "index_info", "shard_info").collect()}
    assert [s.shard for s in events["a"].shard_info] == ["0", "1"] and events["a"].index_info.health == "green"
    assert events["b"].shard_info is None and events["b"].index_info is None
