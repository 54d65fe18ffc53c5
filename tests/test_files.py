"""Real files: terminators, marks, codecs, gzip, tails, passes and streams."""

from __future__ import annotations

import gzip
import json
import os

import pytest

from logtables import jobs
from logtables.operators.state import STATE, load_state, save_state
from logtables.sources import files as src
from logtables.sources.catalogue import LogPattern, search_log_patterns
from logtables.sources.listing import list_files
from logtables.sources.ranges import OPEN_END, TOO_LONG, read_lines, read_range
from logtables.streaming.events import assemble_batch, assemble_stream
from logtables.streaming.tail import tail_stream


def put(folder, name, data, mode="wb"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(data)
    return str(path)


def positions(spark, folder, **kw):
    df = src.position_lines(src.scan_lines(spark, str(folder)), **kw)
    rows = df.select("name", "line_no", "offset", "end_offset", "line").collect()
    return sorted((r["name"], r["line_no"], r["offset"], r["end_offset"], r["line"]) for r in rows)


def test_positions_bom_and_tail(spark, tmp_path):
    put(tmp_path, "a/done.log", b"one\n\nthree\r\n")
    put(tmp_path, "b/open.log", b"one\ntwo")
    put(tmp_path, "bom.log", b"\xef\xbb\xbfone\ntwo\n")
    put(tmp_path, "bomopen.log", b"\xef\xbb\xbfone\ntwo")
    put(tmp_path, "plus+ %41.log", b"x\n")
    put(tmp_path, "z.log.gz", gzip.compress(b"g1\ng2"))
    every = positions(spark, tmp_path)
    assert every == [
        ("bom.log", 1, 0, 7, "one"), ("bom.log", 2, 7, 11, "two"),
        ("bomopen.log", 1, 0, 7, "one"), ("bomopen.log", 2, 7, 10, "two"),
        ("done.log", 1, 0, 4, "one"), ("done.log", 2, 4, 5, ""), ("done.log", 3, 5, 12, "three\r"),
        ("open.log", 1, 0, 4, "one"), ("open.log", 2, 4, 7, "two"),
        ("plus+ %41.log", 1, 0, 2, "x"),
        ("z.log.gz", 1, 0, 3, "g1"), ("z.log.gz", 2, 3, 6, "g2"),
    ]
    kept = {(n, i) for n, i, *_ in positions(spark, tmp_path, withhold=True)}
    assert {(n, i) for n, i, *_ in every} - kept == {("bomopen.log", 2), ("open.log", 2)}
    assert positions(spark, tmp_path, withhold=True, final=True) == every
    paths = {r["path"] for r in src.scan_lines(spark, str(tmp_path)).select("path").distinct().collect()}
    assert str(tmp_path / "plus+ %41.log") in paths
    os.symlink(tmp_path / "bom.log", tmp_path / "link.log")
    assert {r["path"] for r in list_files(spark, str(tmp_path)).collect()} == paths


def test_positions_over_many_splits(spark, tmp_path):
    data = b"".join(b"line %d %s\n" % (i, b"x" * (i % 50)) for i in range(30_000))
    put(tmp_path, "big.log", data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = positions(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at = 0
    for i, line in enumerate(data.split(b"\n")[:-1]):
        assert rows[i][1:] == (i + 1, at, at + len(line) + 1, line.decode())
        at += len(line) + 1
    assert len(rows) == 30_000


@pytest.mark.parametrize("codec,name", [("gbk", "gbk"), ("cp437", "cp437"), ("koi8-r", "koi8r"), ("iso8859-14", "iso8859-14")])
def test_codecs(spark, tmp_path, codec, name):
    text = {"gbk": "日志 行", "cp437": "naïve", "koi8-r": "журнал", "iso8859-14": "Ŵŵ log"}[codec]
    put(tmp_path, "f.log", text.encode(codec) + b"\nplain\n")
    rows = src.decode_lines(src.scan_lines(spark, str(tmp_path)), name).orderBy("mid").collect()
    assert [r["line"] for r in rows] == [text, "plain"]


def test_utf16_file_and_bad_utf8(spark, tmp_path):
    put(tmp_path, "u/f.log", "äö\nzwei\n".encode("utf-16-le"))
    rows = src.decode_lines(src.scan_lines(spark, str(tmp_path / "u"), encoding="utf-16le"), "utf-16le")
    assert [r["line"] for r in rows.orderBy("mid").collect()] == ["äö", "zwei"]
    put(tmp_path, "v/f.log", b"ok\xff!\n")
    rows = src.decode_lines(src.scan_lines(spark, str(tmp_path / "v")), "utf-8").collect()
    assert rows[0]["line"] == "ok�!"


def test_utf16_marks(spark, tmp_path):
    put(tmp_path, "be.log", b"\xfe\xff" + "ä\nb\n".encode("utf-16-be"))
    put(tmp_path, "le.log", b"\xff\xfe" + "c\nö\n".encode("utf-16-le"))
    put(tmp_path, "none.log", "x\n".encode("utf-16-le"))

    def lines(fallback):
        return sorted((r["name"], r["line"]) for r in src.scan_utf16(spark, str(tmp_path), fallback).collect())

    marked = [("be.log", "b"), ("be.log", "ä"), ("le.log", "c"), ("le.log", "ö")]
    assert lines(None) == marked and lines("le") == [*marked, ("none.log", "x")]


def test_range_reader_splits_anywhere(tmp_path):
    data = b"first\n\nthird line\n" + b"y" * 200 + b"\nlast\nopen"
    path = put(tmp_path, "f.log", data)
    for step in (1, 3, 7, 50, 1000):
        got = []
        for start in range(0, len(data), step):
            for batch in read_range(path, start, min(start + step, len(data))):
                got += batch.to_pylist()
        assert [g["line"] for g in got] == data.split(b"\n")[:-1]
        for g in got:
            assert data[g["offset"] : g["end_offset"]] == g["line"] + b"\n"


def test_bounded_reader(tmp_path):
    """Lines over the limit are dropped by block, wherever ranges cut them, and told of with their place."""
    import random

    rng = random.Random(2)
    for _ in range(60):
        lines = [b"x" * rng.choice([0, 1, 5, 20, 60, 200, 900]) for _ in range(rng.randint(1, 12))]
        data = b"\n".join(lines) + rng.choice([b"", b"\n"])
        path, step, limit = put(tmp_path, "r.log", data), rng.choice([7, 50, 300, 5000]), rng.choice([10, 100, 250])
        rows = [
            (r["start"], r["offset"], r["end_offset"], r["line"], r["reason"])
            for start in range(0, len(data), step)
            for batch in read_lines(path, start, min(start + step, len(data)), start + step >= len(data), limit)
            for r in batch.to_pylist()
        ]
        at, want = 0, []
        for line in data.split(b"\n")[: None if data[-1:] != b"\n" else -1]:
            end = min(at + len(line) + 1, len(data))
            if at < len(data):
                want.append((at, end, line if len(line) <= limit else None))
            at = end
        got, opened = [], {}
        for start, offset, end, line, reason in rows:
            if reason == OPEN_END:
                opened[start] = offset
                continue
            if offset is None:
                offset = opened[max(s for s in opened if s < start)]
            got.append((offset, end, line))
        assert got == want, (data, step, limit)


def test_reader_holds_little_of_a_long_line(tmp_path, monkeypatch):
    """Each byte of a line of many ranges is read once, and no more than the limit is held."""
    import tracemalloc

    from logtables.sources import ranges

    path, size, step = str(tmp_path / "long.log"), 48 << 20, 4 << 20
    with open(path, "wb") as f:
        f.write(b"first\n")
        f.seek(size)
        f.write(b"\nlast\n")
    size, read, real = os.path.getsize(path), [0], ranges.open_file

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __enter__(self):
            return self

        def __exit__(self, *rest):
            self.inner.close()

        def seek(self, at):
            self.inner.seek(at)

        def read(self, n):
            read[0] += n
            return self.inner.read(n)

    monkeypatch.setattr(ranges, "open_file", lambda p: Counted(real(p)))
    tracemalloc.start()
    rows = [r for at in range(0, size, step) for b in read_lines(path, at, min(at + step, size), False, 1 << 20) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["line"], r["reason"]) for r in rows] == [(b"first", None), (None, OPEN_END), (None, TOO_LONG), (b"last", None)]
    assert (rows[1]["offset"], rows[2]["offset"], rows[2]["end_offset"]) == (6, None, (48 << 20) + 1)
    assert read[0] < 1.05 * size and peak < 16 << 20


def test_passes_go_on_without_lost_files(spark, tmp_path, monkeypatch):
    """A file gone or replaced between plan and read is told of and taken up later; gzip is unpacked."""
    from logtables.sources import ranges

    logs, state, out = tmp_path / "logs", str(tmp_path / "state"), tmp_path / "out"
    for name in ("a.log", "b.log", "c.log"):
        put(logs, name, f"{name} 1\n{name} 2\n".encode())
    put(logs, "d.log.gz", gzip.compress(b"z 1\nz 2\n"))
    listed = jobs.with_complete_end

    def meddle(df):
        planned = listed(df)
        found = spark.createDataFrame(planned.collect(), planned.schema)
        os.remove(logs / "a.log")
        os.rename(logs / "b.log", tmp_path / "b.old")
        put(logs, "b.log", b"new b\n")
        return found

    patterns = [LogPattern(r"\.log", "text")]
    monkeypatch.setattr(jobs, "with_complete_end", meddle)
    done = {r["name"] for r in jobs.collect_logs(spark, str(logs), patterns, state, str(out), "now").collect()}
    assert done == {"c.log", "d.log.gz"}
    assert sorted(e["payload"]["message"] for e in events_of(out / "pass=1")) == ["c.log 1", "c.log 2", "z 1", "z 2"]
    refused = {os.path.basename(r["path"]): r["reason"] for r in spark.read.parquet(f"{out}-rejects/pass=1").collect()}
    assert refused == {"a.log": "cannot be read: FileNotFoundError", "b.log": ranges.REPLACED}
    monkeypatch.setattr(jobs, "with_complete_end", listed)
    assert {r["name"] for r in jobs.collect_logs(spark, str(logs), patterns, state, str(out), "now").collect()} == {"b.log"}
    assert [e["payload"]["message"] for e in events_of(out / "pass=2")] == ["new b"]


def test_hidden_files_are_scanned_packed_or_not(spark, tmp_path):
    put(tmp_path, ".h.log", b"a\nb")
    put(tmp_path, "_x/y.log", b"c\n")
    put(tmp_path, ".z.log.gz", gzip.compress(b"d\ne\n"))
    put(tmp_path, "plain.log", b"f\n")
    got = sorted((r["name"], r["line_no"], r["line"]) for r in src.with_line_numbers(src.scan_lines(spark, str(tmp_path))).collect())
    assert got == [(".h.log", 1, "a"), (".h.log", 2, "b"), (".z.log.gz", 1, "d"), (".z.log.gz", 2, "e"), ("plain.log", 1, "f"), ("y.log", 1, "c")]


def events_of(folder):
    out = []
    for root, _, names in os.walk(folder):
        for n in names:
            if n.startswith("part-"):
                out += [json.loads(x) for x in open(os.path.join(root, n))]
    return out


def test_passes_follow_growth(spark, tmp_path):
    logs, state, out = tmp_path / "logs", str(tmp_path / "state"), tmp_path / "out"
    patterns = [LogPattern("", "text"), *search_log_patterns({"server": {"text": True}})]
    stamp = "[2024-01-01T00:00:01,234]"
    put(logs, "c_server.json", b'{"type":"server","timestamp":"t1","level":"INFO","message":"a"}\n{"bad\n{"message":"b","log.level":"WARN",\n"x":1}\n')
    put(logs, "c.log", f"{stamp} start\n  at x\n{stamp} half".encode())
    put(logs, "skip.txt", b"no\n")
    ops = {r["name"]: r["op"] for r in jobs.collect_logs(spark, str(logs), patterns, state, str(out), "now").collect()}
    assert ops == {"c_server.json": "create", "c.log": "create"}
    first = events_of(out / "pass=1")
    assert sorted((e["metadata"]["log_type"], e["payload"].get("message"), e["timestamp"]) for e in first) == [
        ("json", "a", "t1"), ("json", "b", "now"), ("multiline", f"{stamp} start\n  at x", "2024-01-01T00:00:01,234"),
    ]
    warn = next(e for e in first if e["payload"].get("message") == "b")
    assert warn["payload"] == {"level": "WARN", "message": "b", "x": 1}
    assert warn["metadata"]["name"] == "server" and warn["metadata"]["file"]["path"].endswith("c_server.json")

    assert jobs.collect_logs(spark, str(logs), patterns, state, str(out), "now").count() == 0

    put(logs, "c.log", f" done\n{stamp} next\n".encode(), "ab")
    os.utime(logs / "c.log", (2_000_000_000, 2_000_000_000))
    ops = [r["op"] for r in jobs.collect_logs(spark, str(logs), patterns, state, str(out), "now").collect()]
    assert ops == ["write"]
    assert sorted(e["payload"]["message"] for e in events_of(out / "pass=2")) == [f"{stamp} half done", f"{stamp} next"]

    os.truncate(logs / "c.log", 0)
    os.utime(logs / "c.log", (2_000_000_050, 2_000_000_050))
    ops = [r["op"] for r in jobs.collect_logs(spark, str(logs), patterns, state, str(out), "now").collect()]
    assert ops == ["truncate"] and events_of(out / "pass=3") == []
    put(logs, "c.log", f"{stamp} new\n".encode(), "ab")
    os.utime(logs / "c.log", (2_000_000_100, 2_000_000_100))
    ops = [r["op"] for r in jobs.collect_logs(spark, str(logs), patterns, state, str(out), "now").collect()]
    assert ops == ["write"]
    assert [e["payload"]["message"] for e in events_of(out / "pass=4")] == [f"{stamp} new"]
    sizes = {r["name"]: (r["size"], r["resume_offset"]) for r in load_state(spark, state).collect()}
    assert sizes["c.log"][0] == sizes["c.log"][1] == len(f"{stamp} new\n")


def test_search_logs_carry_their_job(spark, tmp_path):
    from logtables.operators.envelope import collector_literal, jobs_from_nodes

    for node in ("n1", "n2"):
        put(tmp_path, f"{node}/c_server.json", b'{"timestamp":"t","message":"%s"}\n' % node.encode())
    put(tmp_path, "n2/sub/gc.log", b"[2024-01-01T00:00:01,234] gc\n more\n")
    nodes = spark.createDataFrame(
        [(n, n.upper(), "cid", "c", "u", "9200", f"{tmp_path}/{n}/") for n in ("n1", "n2", "gone")],
        "node_id string, node_name string, cluster_id string, cluster_name string, cluster_uuid string, port string, path_logs string",
    )
    wanted = jobs_from_nodes(nodes, metadata={"team": "x"}, custom_labels={"env": "prod"})
    jobs.collect_search_logs(spark, wanted, str(tmp_path / "state"), str(tmp_path / "out"), "now", collector=collector_literal(queue="q"))
    got = sorted(
        (e["metadata"]["labels"]["node_name"], e["metadata"]["name"], e["payload"]["message"], e["timestamp"])
        for e in events_of(tmp_path / "out")
    )
    assert got == [
        ("N1", "server", "n1", "t"), ("N2", "gc", "[2024-01-01T00:00:01,234] gc\n more", "2024-01-01T00:00:01,234"),
        ("N2", "server", "n2", "t"),
    ]
    one = events_of(tmp_path / "out")[0]
    assert one["metadata"]["team"] == "x" and one["metadata"]["category"] == "elasticsearch"
    assert one["metadata"]["labels"]["env"] == "prod" and one["collector"]["queue"] == "q"
    assert os.listdir(tmp_path / "out" / "pass=1") and os.path.isdir(tmp_path / "out" / "pass=1" / "queue=q")


def test_tail_stream_reads_appends_once(spark, tmp_path):
    logs = tmp_path / "logs"
    put(logs, "a.log", b"a1\na2\na3 open")
    put(logs, "b.log", b"b1\n")

    def run():
        got = []
        stream = tail_stream(spark, str(logs), r"\.log$", range_bytes=4)
        q = (
            stream.writeStream.foreachBatch(lambda df, i: got.extend(df.collect()))
            .option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination(120)
        return sorted((os.path.basename(r["path"]), r["offset"], r["line"]) for r in got)

    assert run() == [("a.log", 0, "a1"), ("a.log", 3, "a2"), ("b.log", 0, "b1")]
    put(logs, "a.log", b"ed\na4\n", "ab")
    assert run() == [("a.log", 6, "a3 opened"), ("a.log", 16, "a4")]
    assert run() == []


def test_stream_assembly_carries_open_events(spark, tmp_path):
    logs, folder = tmp_path / "logs", str(tmp_path / "stream")
    clock = {"now": 100.0}
    got = []

    def run():
        got.clear()
        q = (
            assemble_stream(
                tail_stream(spark, str(logs)), folder,
                lambda df, i: got.extend(df.collect()), r"^\[", clock=lambda: clock["now"], max_lines=4,
            )
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination(120)
        return sorted((os.path.basename(r["path"]), r["content"], r["lines"], tuple(r["flags"])) for r in got)

    put(logs, "a.log", b"[1\n a\n[2\n b\n")
    put(logs, "b.log", b"[x\n")
    assert run() == [("a.log", "[1\n a", 2, ("multiline",))]
    put(logs, "a.log", b" c\n d\n e\n f\n[3\n", "ab")
    clock["now"] += 1
    assert run() == [("a.log", "[2\n b\n c\n d", 6, ("truncated", "multiline"))]
    put(logs, "a.log", b"[4\n", "ab")
    clock["now"] += 4.5
    assert run() == [("a.log", "[3", 1, ()), ("b.log", "[x", 1, ())]


@pytest.mark.parametrize("match", ["after", "before"])
@pytest.mark.parametrize("flush", [None, "^F"])
def test_batches_equal_one_pass(spark, match, flush):
    """Lines delivered in pieces give the events of one pass."""
    import random

    from tests.test_assemble import sequential

    import re

    rnd = random.Random(5)
    lines = {f"p{k}": [rnd.choice(["s1", "c", "F", "x"]) for _ in range(14)] for k in range(6)}
    ddl = "path string, chunk bigint, offset bigint, end_offset bigint, line string, bytes bigint"
    from logtables.streaming.events import CARRY

    carry, got = spark.createDataFrame([], CARRY), {p: [] for p in lines}
    cuts = [0, 3, 4, 9, 14]
    for a, b in zip(cuts, cuts[1:]):
        rows = [(p, i // 2, i * 10, i * 10 + 9, ls[i], len(ls[i]) + 1) for p, ls in lines.items() for i in range(a, b)]
        events = assemble_batch(
            spark.createDataFrame(rows, ddl), carry, 1.0, "^s", match=match, flush_pattern=flush, max_lines=3
        ).collect()
        for r in sorted(events, key=lambda r: r["line_from"]):
            if not r["open"] or b == 14:
                got[r["path"]].append((r["content"], r["lines"], r["flags"]))
        open_rows = [
            (r["path"], r["content"], r["probe"], r["lines"], len(r["content"]) + ("truncated" in r["flags"]), r["bytes"],
             r["offset"], r["end_offset"], "multiline" in r["flags"], r["seen"])
            for r in events if r["open"]
        ]
        carry = spark.createDataFrame(open_rows, CARRY)

    def joins(prev, cur):
        return not re.search("^s", cur if match == "after" else prev)

    assert got == {p: sequential(ls, joins, flush, max_lines=3) for p, ls in lines.items()}


def test_scan_to_events_in_one_pass(spark, tmp_path):
    """A scan cut into many splits gives the events of the whole file, with true offsets."""
    from logtables.operators.assemble import assemble, assemble_count, assemble_while

    data = b"".join(b"[%d] %s\n" % (i, b"x" * (i % 9)) + b"  at y\n" * (i % 4) for i in range(4000))
    put(tmp_path, "big.log", data)
    put(tmp_path, "bom.log", b"\xef\xbb\xbf[a\n b\n[c\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = src.scan_lines(spark, str(tmp_path))
        rows = assemble(lines, r"^\[").collect()
        joined = assemble_while(lines, r"^\s", max_lines=None).filter("path like '%big.log'").count()
        counted = assemble_count(lines, 10).filter("path like '%big.log'").count()
        flushed = assemble(lines, r"^\[", flush_pattern="^never").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    big = sorted((r for r in rows if r["path"].endswith("big.log")), key=lambda r: r["line_from"])
    assert len(big) == 4000 and flushed == len(rows)
    for r in big:
        assert data[r["offset"] : r["end_offset"]].decode() == r["content"] + "\n"
    bom = sorted((r["offset"], r["end_offset"], r["content"]) for r in rows if r["path"].endswith("bom.log"))
    assert bom == [(0, 9, "[a\n b"), (9, 12, "[c")]
    total = data.count(b"\n")
    assert counted == -(-total // 10)
    assert joined == 4000 + sum(1 for i in range(4000) if i % 4)


def test_no_file_is_left_out_by_its_name(spark, tmp_path):
    """Scan, listing and tail see the same files, hidden names and links included."""
    from logtables.operators.serving import list_log_files
    from logtables.sources.files import position_lines, scan_lines
    from logtables.streaming.tail import TailReader

    logs, other = tmp_path / "logs", tmp_path / "other"
    logs.mkdir()
    other.mkdir()
    texts = {"a.log": "1\n2\n3\n", "_b.log": "x\ny", ".c.log": "z\n", "empty.log": ""}
    for name, text in texts.items():
        (logs / name).write_text(text)
    (other / "target.txt").write_text("p\nq\n")
    (logs / "link.log").symlink_to(other / "target.txt")
    lines = position_lines(scan_lines(spark, str(logs))).collect()
    found = {(r.name, r.line_no, r.line) for r in lines}
    assert {("_b.log", 1, "x"), ("_b.log", 2, "y"), (".c.log", 1, "z"), ("a.log", 3, "3")} <= found
    rows, errors = list_log_files(spark, [str(logs), str(tmp_path / "none")])
    counts = {r["name"]: (r.total_rows, r.logs_path) for r in rows.collect()}
    want = {"a.log": 3, "_b.log": 2, ".c.log": 1, "empty.log": 0, "link.log": 2}
    assert counts == {n: (c, str(logs)) for n, c in want.items()} and len(errors) == 1
    tail = TailReader({"roots": json.dumps([str(logs)])}).latestOffset()
    assert {p.rsplit("/", 1)[1] for p in tail} == {*texts, "link.log"}


def test_ranges_are_spread_over_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from logtables.sources.ranges import read_ranges

    for i in range(4):
        (tmp_path / f"f{i}.log").write_text("".join(f"line {n}\n" for n in range(4000)))
    files = spark.createDataFrame([(str(tmp_path / f"f{i}.log"), 0, 38_890) for i in range(4)], "path string, start_offset long, end_offset long")
    lines = read_ranges(files, range_bytes=4000)
    assert lines.count() == 16_000
    assert lines.select(F.spark_partition_id()).distinct().count() >= 8


def test_rejects_are_written(spark, tmp_path):
    from logtables import jobs
    from logtables.sources.catalogue import LogPattern

    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a_server.json").write_text('{"a": 1}\n{broken\n{"b": 2}\n' + '{"c": "' + "y" * 900 + '"}\n')
    pattern = LogPattern(name="json", pattern=r"_server\.json$", type="json")
    out = str(tmp_path / "out")
    jobs.collect_logs(spark, str(logs), [pattern], str(tmp_path / "state"), out, "now", max_bytes=200)
    rows = spark.read.parquet(f"{out}-rejects").collect()
    assert sorted(r.reason for r in rows) == ["line too long", "no JSON object"]


def test_old_state_versions_are_removed(spark, tmp_path):
    folder = str(tmp_path / "state")
    for n in range(1, 6):
        state = load_state(spark, folder).unionByName(
            spark.createDataFrame([(f"/{n}", "x", n, None, "1-1", n)], STATE)
        )
        assert save_state(state, folder, keep=3) == n
    assert sorted(os.listdir(folder)) == ["v=3", "v=4", "v=5"]
    assert {r["path"] for r in load_state(spark, folder).collect()} == {"/1", "/2", "/3", "/4", "/5"}
    # An interrupted write is neither read nor counted; its number is written over.
    os.mkdir(os.path.join(folder, "v=6"))
    assert load_state(spark, folder).count() == 5
    assert save_state(load_state(spark, folder), folder, keep=3) == 6
    assert sorted(os.listdir(folder)) == ["v=4", "v=5", "v=6"]
    with pytest.raises(ValueError):
        save_state(load_state(spark, folder), folder, keep=1)
