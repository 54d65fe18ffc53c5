"""Event assembly against a plain sequential reader."""

from __future__ import annotations

import random
import zlib
import re

import pytest

from logtables.operators.assemble import assemble, assemble_count, assemble_mode, assemble_while


class Buffer:
    """The stored part of one event, limits included."""

    def __init__(self, sep, max_lines, max_bytes):
        self.sep, self.max_lines, self.max_bytes = sep, max_lines, max_bytes
        self.text, self.stored, self.seen, self.lost = b"", 0, 0, 0

    def add(self, line):
        raw = line.encode()
        glue = self.sep if self.text else b""
        room = self.max_bytes - len(self.text) - len(glue)
        if room > 0 and self.stored < self.max_lines:
            self.text += glue + raw[:room]
            self.stored += 1
            self.lost += max(0, len(raw) - room)
        else:
            self.lost += len(raw)
        self.seen += 1

    def flags(self):
        return [n for n, on in (("truncated", self.lost > 0), ("multiline", self.stored > 1)) if on]


def sequential(lines, joins, flush=None, sep=b"\n", max_lines=500, max_bytes=10**7):
    """Read lines one by one; ``joins(previous, current)`` decides."""
    events, buf, last = [], None, None

    def close():
        events.append((buf.text.decode(errors="replace"), buf.seen, buf.flags()))

    for line in lines:
        if buf is None:
            buf = Buffer(sep, max_lines, max_bytes)
            buf.add(line)
        elif flush and re.search(flush, line):
            buf.add(line)
            close()
            buf = None
        elif joins(last, line):
            buf.add(line)
        else:
            close()
            buf = Buffer(sep, max_lines, max_bytes)
            buf.add(line)
        last = line
    if buf:
        close()
    return events


def run(spark, files, build, chunk=None):
    rows = [(p, i + 1, (i // chunk) if chunk else 0, line) for p, ls in files.items() for i, line in enumerate(ls)]
    df = spark.createDataFrame(rows, "path string, line_no bigint, chunk bigint, line string")
    got = {p: [] for p in files}
    for r in sorted(build(df).collect(), key=lambda r: (r["path"], r["line_from"])):
        got[r["path"]].append((r["content"], r["lines"], r["flags"]))
    return got


def random_files(seed, n=40, alphabet=("s1", "c", "F", "x", "s22", "FF", "")):
    rnd = random.Random(seed)
    return {f"f{i}": [rnd.choice(alphabet) for _ in range(rnd.randint(1, 25))] for i in range(n)}


@pytest.mark.parametrize("match", ["after", "before"])
@pytest.mark.parametrize("negate", [True, False])
@pytest.mark.parametrize("flush", [None, "^F"])
def test_pattern_modes(spark, match, negate, flush):
    files = random_files(zlib.crc32(repr((match, negate, flush is None)).encode()) % 1000)

    def joins(prev, cur):
        return bool(re.search("^s", cur if match == "after" else prev)) != negate

    want = {p: sequential(ls, joins, flush) for p, ls in files.items()}
    got = run(spark, files, lambda df: assemble(df, "^s", negate, match, flush_pattern=flush), chunk=4)
    assert got == want


@pytest.mark.parametrize("max_lines,max_bytes", [(2, 1000), (500, 3), (500, 4), (3, 5), (1, 1)])
def test_limits_cross_chunks(spark, max_lines, max_bytes):
    files = random_files(7, alphabet=("s12", "cc", "c", "", "dddd"))

    def joins(prev, cur):
        return not cur.startswith("s")

    want = {p: sequential(ls, joins, max_lines=max_lines, max_bytes=max_bytes) for p, ls in files.items()}
    got = run(
        spark, files, lambda df: assemble(df, "^s", max_lines=max_lines, max_bytes=max_bytes), chunk=3
    )
    assert got == want


def test_count_and_while(spark):
    files = random_files(3)
    got = run(spark, files, lambda df: assemble_count(df, 4), chunk=3)
    for p, ls in files.items():
        want = []
        for i in range(0, len(ls), 4):
            want += sequential(ls[i : i + 4], lambda a, b: True)
        assert got[p] == want
    got = run(spark, files, lambda df: assemble_while(df, "^s"), chunk=3)
    for p, ls in files.items():
        assert got[p] == sequential(ls, lambda a, b: a.startswith("s") and b.startswith("s"))


def test_separator(spark):
    files = {"f": ["s", "a", "b"]}
    assert run(spark, files, lambda df: assemble(df, "^s", separator="|"))["f"][0][0] == "s|a|b"
    assert run(spark, files, lambda df: assemble(df, "^s", skip_newline=True))["f"][0][0] == "sab"


def test_mode_validation(spark):
    df = spark.createDataFrame([("f", 1, "s")], "path string, line_no bigint, line string")
    for bad in ({"type": "pattern"}, {"type": "count"}, {"type": "while_pattern"}, {"type": "other"}):
        with pytest.raises(ValueError):
            assemble_mode(df, **bad)
    with pytest.raises(ValueError):
        assemble_mode(df, pattern="^s", match="beside")
    assert assemble_mode(df, pattern="^s").count() == 1
    assert assemble_mode(df, type="count", count=2).count() == 1
    assert assemble_mode(df, type="while_pattern", pattern="x").count() == 1


def test_one_event_over_a_whole_file_stays_bounded(spark):
    n = 20_000
    df = spark.range(n).selectExpr("'f' as path", "id + 1 as line_no", "id div 1000 as chunk", "'c' as line")
    row = assemble(df, "^never").collect()[0]
    assert (row["lines"], len(row["content"]), row["flags"]) == (n, 999, ["truncated", "multiline"])


def test_endless_record_is_bounded_across_chunks(spark):
    """A record over 200 chunks keeps its byte limit and one line at most; counts stay exact."""
    text = "x" * 20
    lines = spark.range(10_000).selectExpr("'f' as path", "id + 1 as line_no", "id div 50 as chunk", f"'{text}' as line", "1L as first")
    second = spark.range(100).selectExpr("'f' as path", "id + 10001 as line_no", "200 + id div 50 as chunk", f"'{text}' as line", "10001L as first")
    keyed = lines.unionByName(second)
    from logtables.operators import assemble as module

    rows = {r.line_from: r for r in module.collect_events(keyed, None, 1000, "\n", False).collect()}
    assert rows[1].lines == 10_000 and len(rows[1].content) == 1000 and "truncated" in rows[1].flags
    assert rows[10001].lines == 100 and len(rows[10001].content) == 1000
    frame = "partition by path, chunk order by line_no rows between unbounded preceding and current row"
    held = keyed.selectExpr("*", f"sum(20) over ({frame}) as _upto").selectExpr("*", f"max(if(line_no = first, _upto - 20, null)) over ({frame}) as _from")
    kept = module._with_carry(held).filter("_upto - 20 - coalesce(_from, -_carry) < 1000").groupBy("first").count().collect()
    assert {r["first"]: r["count"] for r in kept} == {1: 50, 10001: 50}
