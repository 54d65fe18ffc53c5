"""Continuous collection, identity by content, folders walked in tasks, and pages by index."""

from __future__ import annotations

import gzip
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logtables import jobs
from logtables.operators.pages import index_lines, indexed_lines, pages_by_index, ranges_of_pages
from logtables.operators.state import classify_changes, load_state
from logtables.plans.pass_queries import forget_commit
from logtables.sources import ranges
from logtables.sources.catalogue import LogPattern
from logtables.sources.listing import list_files
from logtables.sources.ranges import with_identity
from logtables.streaming.tail import FileRange, TailReader

PATTERN = LogPattern(r"\.log$", "multiline", metadata={"name": "t"}, line_pattern=r"^\[")


def _messages(spark, folder):
    rows = spark.read.text(folder).select(F.get_json_object("value", "$.payload.message")).collect()
    return Counter(r[0] for r in rows)


def test_stream_holds_open_events_and_repeats_a_batch_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("[1] x\n more\n[2] y\n")
    (logs / "b.log").write_text("[only] z\n")
    state, out, cp = (str(tmp_path / n) for n in ("state", "out", "cp"))

    def batch(idle):
        stream = jobs.collect_stream(spark, str(logs), [PATTERN], state, out, idle=idle)
        stream.option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()

    batch(1e6)
    assert _messages(spark, out) == Counter({"[1] x\n more": 1})
    kept = {r["name"]: r["resume_offset"] for r in load_state(spark, state).collect()}
    assert kept == {"a.log": 12, "b.log": 0}
    with open(logs / "a.log", "a") as f:
        f.write(" late\n[3] w\n")
    batch(1e6)
    assert _messages(spark, out) == Counter({"[1] x\n more": 1, "[2] y\n late": 1})
    forget_commit(spark, cp, 1)
    batch(1e6)  # the same batch again
    assert _messages(spark, out) == Counter({"[1] x\n more": 1, "[2] y\n late": 1})
    batch(0.0)  # nothing was written, but the files are quiet now
    assert _messages(spark, out) == Counter({"[1] x\n more": 1, "[2] y\n late": 1, "[3] w": 1, "[only] z": 1})
    batch(0.0)
    assert sum(_messages(spark, out).values()) == 4


def test_open_event_over_the_limit_is_not_waited_for(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("[1] x\n" + " y\n" * 50)
    jobs.collect_logs(spark, str(logs), [PATTERN], str(tmp_path / "s"), str(tmp_path / "o"), "now", max_bytes=100, idle=1e6)
    assert sum(_messages(spark, str(tmp_path / "o")).values()) == 1


def test_files_without_inode_are_known_by_their_head(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    contents = {"grown": b"ab\n", "long": b"x" * 3000, "replaced": b"old\n", "cut": b"k" * 2000 + b"\n", "same": b"s\n", "empty": b""}
    for name, data in contents.items():
        (root / name).write_bytes(data)
    uri = "file://" + str(root)
    empty = load_state(spark, str(tmp_path / "none"))
    first = with_identity(list_files(spark, uri), empty)
    assert {r["op"] for r in classify_changes(first, empty).collect()} == {"create"}
    state = first.withColumn("resume_offset", F.col("size")).drop("head", "root", "walked")
    state.write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    (root / "grown").write_bytes(b"ab\ncd\n")
    (root / "long").write_bytes(b"x" * 5000)
    (root / "replaced").write_bytes(b"new and longer\n")
    (root / "cut").write_bytes(b"k" * 1500)
    (root / "empty").write_bytes(b"now\n")
    for name in ("grown", "long", "replaced", "cut", "empty"):
        os.utime(root / name, (2e9, 2e9))
    now = with_identity(list_files(spark, uri), state)
    found = {r["name"]: (r["op"], r["start_offset"]) for r in classify_changes(now, state).collect()}
    assert found == {
        "grown": ("write", 3), "long": ("write", 3000), "replaced": ("create", 0), "cut": ("truncate", 0), "empty": ("write", 0)
    }
    heads = {r["name"]: r["head"] for r in now.collect()}
    assert heads["grown"].startswith("head:6:") and heads["long"].startswith("head:1024:") and heads["same"] is None


def test_pass_over_a_remote_path_goes_on_where_it_was(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("[1]\n[2]\n")
    args = ("file://" + str(logs), [PATTERN], str(tmp_path / "s"), str(tmp_path / "o"), "now")
    jobs.collect_logs(spark, *args)
    with open(logs / "a.log", "a") as f:
        f.write("[3]\n")
    jobs.collect_logs(spark, *args)
    with open(logs / "a.log", "a") as f:
        f.write("[4]\n")
    jobs.collect_logs(spark, *args)
    assert _messages(spark, str(tmp_path / "o")) == Counter({"[1]": 1, "[2]": 1, "[3]": 1, "[4]": 1})


def test_reader_refuses_a_file_with_another_head(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"first\nsecond\n")
    with ranges.open_file(str(path)) as f:
        name = ranges.head_identity(f)
    path.write_bytes(b"first\nsecond\nthird\n")
    rows = [r for b in ranges.read_lines(str(path), 13, 19, identity=name) for r in b.to_pylist()]
    assert [r["line"] for r in rows] == [b"third"]
    path.write_bytes(b"other\nsecond\nthird\n")
    rows = [r for b in ranges.read_lines(str(path), 13, 19, identity=name) for r in b.to_pylist()]
    assert [r["reason"] for r in rows] == [ranges.REPLACED]


def test_tail_does_not_read_a_file_that_took_the_place(tmp_path):
    path = tmp_path / "f.log"
    path.write_text("a\nb\n")
    reader = TailReader({"roots": json.dumps([str(tmp_path)])})
    (part,) = reader.partitions({}, reader.latestOffset())
    assert [r["line"] for b in reader.read(part) for r in b.to_pylist()] == [b"a", b"b"]
    os.rename(path, tmp_path / "f.log.1")
    path.write_text("c\nd\n")
    assert [r for b in reader.read(part) for r in b.to_pylist()] == []
    gone = FileRange(str(tmp_path / "none.log"), 0, 4, "1-1")
    assert list(reader.read(gone)) == []


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_folders_of_all_depths_are_listed_once(spark, tmp_path, scheme):
    wanted = set()
    for folder in ("", "a", "a/b", "a/b/c", "a/b/c/d", "e f", "e f/g%20"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / "x.log").write_text("1\n")
        wanted.add(str(tmp_path / folder / "x.log"))
    os.symlink(tmp_path / "a", tmp_path / "linked")
    found = [r["path"] for r in list_files(spark, scheme + str(tmp_path)).collect()]
    assert len(found) == len(set(found))
    assert {p.removeprefix("file://") for p in found} >= wanted
    if not scheme:
        assert set(found) == wanted
        flat = list_files(spark, str(tmp_path), recursive=False).collect()
        assert [r["path"] for r in flat] == [str(tmp_path / "x.log")]


def _files(folder):
    folder.mkdir()
    texts = {
        "plain.log": "".join(f"line {n} {'x' * (n % 40)}\n" for n in range(1, 501)) + "no end",
        "blank.log": "\n" * 300,
        "long.log": "y" * 5000 + "\n" + "z\n" * 10,
        "empty.log": "",
    }
    for name, text in texts.items():
        (folder / name).write_text(text)
    texts["packed.gz"] = "".join(f"packed {n}\n" for n in range(1, 201))
    (folder / "packed.gz").write_bytes(gzip.compress(texts["packed.gz"].encode()))
    return texts


def test_pages_by_index_are_those_of_the_whole_file(spark, tmp_path):
    texts = _files(tmp_path / "logs")
    index = index_lines(list_files(spark, str(tmp_path / "logs")), range_bytes=512)
    asked = [(name, start, count) for name in texts for start, count in ((-3, 2), (1, 1), (7, 30), (190, 400), (500, 1), (501, 2), (9999, 3))]
    requests = spark.createDataFrame(
        [(f"{n}:{s}:{c}", str(tmp_path / "logs" / n), s, c) for n, s, c in asked], "request_id string, path string, start_line int, lines int"
    )
    got = {}
    for r in pages_by_index(index, requests).collect():
        got.setdefault(r["request_id"], []).append((r["line_no"], r["content"], r["eof"]))
    for name, start, count in asked:
        lines = texts[name].split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        first = max(start, 1)
        page = lines[first - 1 : first - 1 + count]
        want = [(first + k, text, len(page) < count) for k, text in enumerate(page)]
        assert sorted(got.get(f"{name}:{start}:{count}", [])) == want, (name, start, count)


def test_a_page_opens_only_its_ranges(spark, tmp_path):
    _files(tmp_path / "logs")
    path = str(tmp_path / "logs" / "plain.log")
    index = index_lines(list_files(spark, str(tmp_path / "logs")), range_bytes=512)
    requests = spark.createDataFrame([("p", path, 300, 5)], "request_id string, path string, start_line int, lines int")
    opened = ranges_of_pages(index, requests).collect()
    assert index.filter(F.col("path") == path).count() > 20
    assert 1 <= len(opened) <= 2 and {r["path"] for r in opened} == {path}
    lines = sorted(r["line_no"] for r in indexed_lines(ranges_of_pages(index, requests)).collect())
    assert lines == [300, 301, 302, 303, 304]


def test_lines_of_pages_are_not_broadcast(spark, tmp_path):
    """A request is a small row that becomes as many as it asks for lines; estimates see the row."""
    _files(tmp_path / "logs")
    index_lines(list_files(spark, str(tmp_path / "logs")), range_bytes=512).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    requests = index.groupBy("path").agg(F.sum("lines").cast("int").alias("lines")).select(
        F.col("path").alias("request_id"), "path", F.lit(1).alias("start_line"), "lines"
    )
    pages = pages_by_index(index, requests)
    assert len(pages.collect()) == 500 + 300 + 11 + 200
    assert "Broadcast" not in pages._jdf.queryExecution().executedPlan().toString()


def test_index_grows_with_the_file(spark, tmp_path):
    folder = tmp_path / "logs"
    _files(folder)
    first = index_lines(list_files(spark, str(folder)), range_bytes=512)
    first.write.parquet(str(tmp_path / "i1"))
    first = spark.read.parquet(str(tmp_path / "i1"))
    with open(folder / "plain.log", "a") as f:
        f.write(" now it has\n" + "more\n" * 200)
    (folder / "blank.log").write_text("short\n")
    os.rename(folder / "long.log", folder / "away.log")
    (folder / "long.log").write_text("another\nfile\n" + "q\n" * 5000)
    listing = list_files(spark, str(folder))
    key = ("path", "inode", "start", "end", "last", "lines", "first_line")
    grown = Counter(tuple(r[k] for k in key) for r in index_lines(listing, first, range_bytes=512).collect())
    fresh = Counter(tuple(r[k] for k in key) for r in index_lines(listing, range_bytes=512).collect())
    assert grown == fresh
