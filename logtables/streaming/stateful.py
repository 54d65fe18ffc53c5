"""Continuous event assembly with state and timers.

Lines of a range are folded where they are read: events that begin and end inside it are
complete and leave at once, under a key of the range. What depends on the lines before the
range (its head) and what the range leaves open (its tail) become a few segments, which go to
the state of their path. So a busy file costs its key two or three rows a range, however many
lines it has. The state holds the open event of a path, no more text than an event may have;
a processing-time timer hands it over when the path has been quiet for ``idle`` seconds, in a
batch without input too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.match import matches
from ..operators.assemble import MAX_BYTES, MAX_LINES, joined_texts

IDLE_SECONDS = 5.0
#: The store that keeps state larger than memory; needed for timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EVENT = "path string, texts array<string>, lines long, size long, bytes long, offset long, end_offset long"
_SEGMENT = f"{_EVENT}, part long, seq int, kind string, joins boolean"
_STATE = "texts array<string>, lines long, size long, bytes long, offset long, end_offset long, open boolean, joins boolean, due long"
_FIELDS = ("texts", "lines", "size", "bytes", "offset", "end_offset")

# What a segment does to the open event of its path. ADD appends (or begins one); CLOSE appends and
# ends it, unless there is none to end; START ends it and begins another; BREAK only ends it; ASK is
# START if the line before, which another range holds, does not join its successor, else ADD. DONE is
# a complete event.
ADD, CLOSE, START, BREAK, ASK, DONE = "add", "close", "start", "break", "ask", "done"


class Event:
    """An event being put together: the text that may be stored, and counts of everything."""

    __slots__ = ("texts", "lines", "size", "bytes", "offset", "end_offset")

    def __init__(self, texts=(), lines=0, size=0, bytes=0, offset=0, end_offset=0):
        self.texts, self.lines, self.size, self.bytes, self.offset, self.end_offset = list(texts), lines, size, bytes, offset, end_offset

    def add(self, other: Event, max_lines: int, max_bytes: int) -> None:
        if not self.lines:
            self.offset = other.offset
        stored, lines = self.size, self.lines
        for text in other.texts:
            if lines >= max_lines or stored >= max_bytes:
                break
            self.texts.append(text)
            lines += 1
            stored += len(text.encode())
        self.lines += other.lines
        self.size += other.size
        self.bytes += other.bytes
        self.end_offset = other.end_offset

    def row(self) -> tuple:
        return (self.texts, self.lines, self.size, self.bytes, self.offset, self.end_offset)


def _line(row) -> Event:
    text = row.line or ""
    return Event([text], 1, len(text.encode()), row.bytes, row.offset, row.end_offset)


class Rules:
    """How lines make events: ``pattern`` (after or before), ``while_pattern`` or ``count``."""

    def __init__(self, type: str, before: bool, count: int, max_lines: int | None, max_bytes: int | None):
        self.type, self.before, self.count = type, before, count
        self.max_lines, self.max_bytes = max_lines or 1 << 60, max_bytes or 1 << 60

    def fold(self, lines: pd.DataFrame) -> list[tuple[str, Event, bool]]:
        """(what, event, whether its last line joins the next) of a range's lines in order."""
        out: list[tuple[str, Event, bool]] = []
        current: tuple[str, Event] | None = None
        sure, joined = False, True  # is it known what is open here; does the line before join

        def end(done: bool = False) -> None:
            nonlocal current
            if current:
                out.append((DONE if done else current[0], current[1], joined))
            current = None

        for row in lines.itertuples(index=False):
            event, first = _line(row), not out and current is None
            if self.type == "count":
                out.append((ADD, event, True))
                continue
            if self.type == "while_pattern":
                if row.joins:
                    if current is None:
                        current = (START if sure else ADD, Event())
                    current[1].add(event, self.max_lines, self.max_bytes)
                else:
                    if sure:
                        end(True)
                    else:
                        end()
                        out.append((BREAK, Event(offset=row.offset, end_offset=row.offset), False))
                    out.append((DONE, event, False))
                    sure = True
                continue
            opened = current is not None
            if row.closes and not (sure and not opened):
                if sure:
                    current[1].add(event, self.max_lines, self.max_bytes)
                    joined = bool(row.joins)
                    end(True)
                else:
                    end()
                    out.append((CLOSE, event, bool(row.joins)))
            else:
                if self.before:
                    starts = not joined and not first
                    kind = ASK if first else START if starts else ADD
                else:
                    kind = ADD if row.joins else START
                if sure and not opened:
                    kind = START
                if kind == START:
                    end(sure)
                    if not sure:  # from here on nothing depends on what was open before
                        out.append((BREAK, Event(offset=row.offset, end_offset=row.offset), False))
                        sure = True
                if current is None:
                    current = (kind, Event())
                current[1].add(event, self.max_lines, self.max_bytes)
            joined = bool(row.joins)
        end()
        return out


def _folded(rules: Rules) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = ["path", *_FIELDS, "part", "seq", "kind", "joins"]

    def segments(lines: pd.DataFrame) -> pd.DataFrame:
        rows = []
        lines = lines.sort_values(["path", "offset"], kind="stable")
        # Only lines that follow each other are folded, however they were dealt.
        piece = (lines["path"].ne(lines["path"].shift()) | lines["offset"].ne(lines["end_offset"].shift())).cumsum()
        for _, group in lines.groupby(piece, sort=False):
            path, own = group["path"].iloc[0], int(group["offset"].iloc[0])
            # A key costs more than a row, so the complete events of a piece share one.
            for seq, (kind, event, joins) in enumerate(rules.fold(group)):
                rows.append((path, *event.row(), own if kind == DONE else -1, seq, kind, joins))
        return pd.DataFrame(rows, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Batches of a range follow each other; each is folded by itself, the state joins them.
        for batch in batches:
            yield segments(batch)

    return run


class OpenEvents(StatefulProcessor):
    """The open event of each path."""

    def __init__(self, rules: Rules, idle: float):
        self.rules, self.idle_ms = rules, int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", _STATE)

    def _rows(self, path: str, events: list[Event]) -> pd.DataFrame:
        return pd.DataFrame([(path, *e.row()) for e in events], columns=["path", *_FIELDS])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        path, part = key
        if part >= 0:
            for batch in rows:
                yield batch[["path", *_FIELDS]]
            return
        segments = pd.concat(list(rows), ignore_index=True).sort_values(["offset", "end_offset", "seq"], kind="stable")
        known = self.state.get() if self.state.exists() else None
        open_event = Event(*known[:6]) if known and known[6] else None
        end = known[5] if known else 0
        joined = bool(known[7]) if known else True
        done: list[Event] = []

        def close() -> None:
            nonlocal open_event
            if open_event:
                done.append(open_event)
            open_event = None

        for row in segments.itertuples(index=False):
            event = Event(row.texts, *(int(getattr(row, f)) for f in _FIELDS[1:]))
            if event.offset < end:  # another file under the name, or one written anew
                close()
                joined = True
            end = event.end_offset
            if row.kind in (START, BREAK) or (row.kind == ASK and not joined):
                close()
            begins = open_event is None
            if row.kind != BREAK:
                open_event = open_event or Event()
                open_event.add(event, self.rules.max_lines, self.rules.max_bytes)
            if row.kind == CLOSE and not begins or self.rules.type == "count" and open_event.lines == self.rules.count:
                close()
            joined = bool(row.joins)
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        if known and known[6] and known[8] > 0:
            self.handle.deleteTimer(known[8])
        if open_event:
            self.handle.registerTimer(due)
        kept = open_event or Event(offset=end, end_offset=end)
        self.state.update((*kept.row(), open_event is not None, joined, due if open_event else 0))
        if done:
            yield self._rows(path, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get()
        if known and known[6]:
            event = Event(*known[:6])
            self.state.update(([], 0, 0, 0, event.end_offset, event.end_offset, False, True, 0))
            yield self._rows(key[0], [event])

    def close(self) -> None:
        pass


def assemble_events(
    lines: DataFrame,
    type: str = "pattern",
    pattern: str | None = None,
    negate: bool | None = None,
    match: str = "after",
    flush_pattern: str | None = None,
    count: int | None = None,
    idle: float = IDLE_SECONDS,
    max_lines: int | None = None,
    max_bytes: int | None = MAX_BYTES,
    separator: str = "\n",
    skip_newline: bool = False,
) -> DataFrame:
    """A stream of lines (path, offset, end_offset, line, bytes) to a stream of events.

    The types and options are those of ``operators.assemble``. An event is handed over when the
    next one begins, when a line closes it, or ``idle`` seconds after its last line. Columns:
    path, lines, bytes, offset, end_offset, content, flags. A path whose offsets begin again is
    another file: what was open is handed over. In count mode every line goes to its path's
    state, as nothing can be known before the lines are counted. ``max_lines`` is ``MAX_LINES``, or
    the count, unless it is given; 0 does not limit.
    """
    if type not in ("pattern", "count", "while_pattern"):
        raise ValueError(f"unknown assembly type {type!r}")
    if type == "count" and not (count and count > 0):
        raise ValueError("count mode needs a line count")
    if type != "count" and not pattern:
        raise ValueError(f"{type} mode needs a pattern")
    if match not in ("after", "before"):
        raise ValueError(f"match must be 'after' or 'before', not {match!r}")
    if type == "count":
        max_lines = count if max_lines is None else max_lines
    max_lines = MAX_LINES if max_lines is None else max_lines
    negate = (type == "pattern") if negate is None else negate

    def holds(text: str | None) -> Column:
        return F.lit(False) if text is None else F.coalesce(matches("line", text), F.lit(False))

    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    joins = holds(pattern) if type != "count" else F.lit(True)
    joins = ~joins if negate and type != "count" else joins
    rules = Rules(type, match == "before", count or 0, max_lines, max_bytes)
    marked = lines.filter(F.col("path").isNotNull()).select(
        "path", "line", F.col("bytes").cast("long").alias("bytes"), F.col("offset").cast("long").alias("offset"),
        F.col("end_offset").cast("long").alias("end_offset"), joins.alias("joins"), holds(flush_pattern).alias("closes"),
    )
    segments = marked.mapInPandas(_folded(rules), _SEGMENT)
    events = segments.groupBy("path", "part").transformWithStateInPandas(
        OpenEvents(rules, idle), outputStructType=_EVENT, outputMode="append", timeMode="processingTime"
    )
    events = events.selectExpr("path", "lines", "bytes", "offset", "end_offset", "texts as _texts", "size as _size")
    return joined_texts(events, max_bytes, "" if skip_newline else separator)
