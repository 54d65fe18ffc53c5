"""Event assembly with state and timers, against a plain sequential reader."""

from __future__ import annotations

import os
import random
import re
import time
from types import SimpleNamespace

import pandas as pd
import pytest

from logtables.operators.assemble import assemble_mode
from logtables.streaming.stateful import _FIELDS, OpenEvents, Rules, _folded, assemble_events
from logtables.streaming.tail import tail_stream

from .test_assemble import sequential


class Store:
    """What a processor sees of the state store, for one path."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def streamed(rules, joins, closes, lines, cuts, flush_after=()):
    """Events of lines that come in batches; a timer fires after the batches of ``flush_after``."""
    store, out, offset = Store(), [], 0
    processor = OpenEvents(rules, 5.0)
    processor.init(store)
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1000)
    fold = _folded(rules)
    bounds = [0, *cuts, len(lines)]
    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
        rows = []
        for line in lines[a:b]:
            rows.append(("p", line, len(line) + 1, offset, offset + len(line) + 1, joins(line), closes(line)))
            offset += len(line) + 1
        batch = pd.DataFrame(rows, columns=["path", "line", "bytes", "offset", "end_offset", "joins", "closes"])
        # Ranges of a batch may come in any order.
        half = len(batch) // 2
        parts = pd.concat([x for piece in (batch[half:], batch[:half]) if len(piece) for x in fold(iter([piece]))] or [pd.DataFrame()])
        for key, rows in parts.groupby("part") if len(parts) else ():
            for found in processor.handleInputRows(("p", key), iter([rows]), clock):
                out += found.to_dict("records")
        if n in flush_after:
            assert len(store.timers) <= 1
            for at in [*store.timers]:
                store.timers.remove(at)
                for found in processor.handleExpiredTimer(("p", -1), clock, None):
                    out += found.to_dict("records")
    for found in processor.handleExpiredTimer(("p", -1), clock, None):
        out += found.to_dict("records")
    out.sort(key=lambda r: r["offset"])
    assert sum(r["bytes"] for r in out) == offset and sum(r["lines"] for r in out) == len(lines)
    return [("\n".join(r["texts"]), r["lines"]) for r in out]


@pytest.mark.parametrize("match", ["after", "before"])
@pytest.mark.parametrize("flush", [None, "^F"])
def test_pattern_in_pieces_equals_one_reader(match, flush):
    rng = random.Random(3)
    for _ in range(400):
        lines = [rng.choice(["s", "c", "F", "x"]) for _ in range(rng.randint(0, 16))]
        cuts = sorted(rng.sample(range(len(lines) + 1), min(len(lines), rng.randint(0, 4))))
        joins = lambda line: not line.startswith("s")
        closes = lambda line: bool(flush and re.search(flush, line))
        rules = Rules("pattern", match == "before", 0, 500, 10**7)
        want = sequential(lines, (lambda last, now: joins(now)) if match == "after" else (lambda last, now: joins(last)), flush)
        assert streamed(rules, joins, closes, lines, cuts) == [(c, n) for c, n, _ in want], (lines, cuts)


def test_while_and_count_in_pieces():
    rng = random.Random(4)
    for _ in range(300):
        lines = [rng.choice(["m", "m", "x"]) for _ in range(rng.randint(0, 14))]
        cuts = sorted(rng.sample(range(len(lines) + 1), min(len(lines), rng.randint(0, 4))))
        want, run = [], []
        for line in [*lines, "x"]:
            if line == "m":
                run.append(line)
                continue
            want += [("\n".join(run), len(run))] if run else []
            want.append((line, 1))
            run = []
        got = streamed(Rules("while_pattern", False, 0, 500, 10**7), lambda s: s == "m", lambda s: False, lines, cuts)
        assert got == want[:-1]
        got = streamed(Rules("count", False, 3, 3, 10**7), lambda s: True, lambda s: False, lines, cuts)
        assert got == [("\n".join(lines[i : i + 3]), len(lines[i : i + 3])) for i in range(0, len(lines), 3)]


def test_timer_ends_an_event_and_state_is_bounded():
    rules = Rules("pattern", False, 0, 2, 10**7)
    got = streamed(rules, lambda s: s != "s", lambda s: False, ["s", "c", "c", "c", "c", "s", "c"], [2, 5], flush_after=(1,))
    assert got == [("s\nc", 5), ("s\nc", 2)]
    # After a timer the next line begins an event, whatever it is.
    got = streamed(Rules("pattern", False, 0, 9, 99), lambda s: s != "s", lambda s: False, ["s", "c", "c"], [2], flush_after=(0,))
    assert got == [("s\nc", 2), ("c", 1)]


def test_options():
    for bad in ({"type": "x"}, {"type": "count"}, {"pattern": None}, {"pattern": "a", "match": "beside"}):
        with pytest.raises(ValueError):
            assemble_events(None, **bad)


def drain(stream, folder, steps, tmp_path, expect, seconds=90):
    """Runs a stream while ``steps`` change the files; each step waits for so many rows."""
    got = []
    query = (
        stream.writeStream.foreachBatch(lambda df, i: got.extend(df.collect()))
        .option("checkpointLocation", folder).trigger(processingTime="200 milliseconds").start()
    )
    try:
        for step, rows in zip(steps, expect):
            step()
            until = time.time() + seconds
            while len(got) < rows and time.time() < until and query.exception() is None:
                time.sleep(0.2)
            assert len(got) == rows, (got, query.exception())
    finally:
        query.stop()
    return got


def test_stream_with_timers(spark, tmp_path):
    """An event over two batches, and one that a timer hands over while its file is quiet."""
    logs = tmp_path / "logs"
    logs.mkdir()

    def put(name, text):
        with open(logs / name, "a") as f:
            f.write(text)

    events = assemble_events(tail_stream(spark, str(logs)), pattern=r"^\[", idle=6.0, max_lines=3)
    steps = [
        lambda: put("a.log", "[0\n[1\n a\n"),  # [0 is complete
        lambda: put("a.log", " b\n c\n[2\n"),  # goes on with [1
        lambda: None,  # [2 after six quiet seconds
    ]
    got = drain(events, str(tmp_path / "cp"), steps, tmp_path, [1, 2, 3])
    assert [(os.path.basename(r.path), r.content, r.lines, r.flags) for r in got] == [
        ("a.log", "[0", 1, []), ("a.log", "[1\n a\n b", 4, ["truncated", "multiline"]), ("a.log", "[2", 1, []),
    ]


@pytest.mark.parametrize("options", [
    {"type": "pattern", "pattern": "^s", "negate": True, "flush_pattern": "^F", "max_bytes": 7},
    {"type": "pattern", "pattern": "^s", "negate": True, "match": "before", "max_lines": 2},
    {"type": "while_pattern", "pattern": "^[Fc]"},
    {"type": "count", "count": 4},
])
def test_stream_equals_batch_operator(spark, tmp_path, options):
    rng, rows = random.Random(8), []
    for p in range(5):
        offset = 0
        for n in range(30):
            line = rng.choice(["s1", "ccc", "F", "x", "", "ä"])
            rows.append((f"p{p}", n + 1, line, len(line.encode()) + 1, offset, offset + len(line.encode()) + 1))
            offset = rows[-1][-1]
    ddl = "path string, line_no bigint, line string, bytes bigint, offset bigint, end_offset bigint"
    whole = spark.createDataFrame(rows, ddl)
    want = sorted((r.path, r.offset, r.content, r.lines, r.bytes, tuple(r.flags)) for r in assemble_mode(whole, **options).collect())
    folder = str(tmp_path / "in")
    for n, (low, high) in enumerate(((0, 7), (7, 8), (8, 31))):
        whole.filter(f"line_no > {low} and line_no <= {high}").coalesce(1).write.mode("append").json(folder)
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(folder)
    # Files come by their time; the last events of the files by the timer.
    got = drain(assemble_events(stream, idle=6.0, **options), str(tmp_path / "cp"), [lambda: None], tmp_path, [len(want)])
    assert sorted((r.path, r.offset, r.content, r.lines, r.bytes, tuple(r.flags)) for r in got) == want
