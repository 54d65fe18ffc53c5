"""Which files are read, and how: routing by file name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import OBJECT
from ..functions.match import matches
from ..functions.timestamps import SEARCH_LOG_TIMESTAMPS


@dataclass(frozen=True)
class LogPattern:
    """A file name pattern and how its files become events."""

    pattern: str
    type: str = "text"
    name: str = ""
    metadata: Mapping[str, object] = field(default_factory=dict)
    line_pattern: str = ""
    remove_fields: Sequence[str] = ()
    timestamp_fields: Sequence[str] = ()
    timestamp_patterns: Sequence[str] = ()

    def __post_init__(self) -> None:
        if self.type not in ("json", "text", "multiline"):
            raise ValueError(f"log type must be json, text or multiline, not {self.type!r}")


# Keys the envelope repeats, and the keys holding the event time.
ENVELOPE_KEYS = (
    "type", "cluster.name", "cluster.uuid", "node.name", "node.id", "timestamp", "@timestamp",
    "elasticsearch.cluster.name", "elasticsearch.cluster.uuid", "elasticsearch.node.id", "elasticsearch.node.name",
)
TIMESTAMP_KEYS = ("timestamp", "@timestamp")

# Log kinds of a search node and their file name endings.
_JSON_LOGS = (
    ("server", ".*_server.json$"),
    ("search_slow", ".*_index_search_slowlog.json$"),
    ("indexing_slow", ".*_index_indexing_slowlog.json$"),
    ("deprecation", ".*_deprecation.json$"),
    ("audit", ".*_audit.json$"),
)
_TEXT_LOGS = (
    ("gc", "gc.log$"),
    ("search_slow", ".*_index_search_slowlog.log$"),
    ("indexing_slow", ".*_index_indexing_slowlog.log$"),
    ("deprecation", ".*_deprecation.log$"),
    ("audit", ".*_audit.log$"),
    ("server", ".*.log$"),
)
_NAMES = {"search_slow": "index_search_slowlog", "indexing_slow": "index_indexing_slowlog"}
DEFAULT_FLAGS = {
    "server": {"json": True}, "search_slow": {"json": True}, "indexing_slow": {"json": True},
    "deprecation": {"json": True}, "audit": {"json": True}, "gc": {"text": True},
}


def search_log_patterns(flags: Mapping[str, Mapping[str, bool]] | None = None) -> list[LogPattern]:
    """Patterns for a search node's logs; the catch-all text pattern comes last."""
    on = {kind: {**DEFAULT_FLAGS.get(kind, {}), **(flags or {}).get(kind, {})} for kind in DEFAULT_FLAGS}
    out = []
    for kind, pattern in _JSON_LOGS:
        if on[kind].get("json"):
            name = _NAMES.get(kind, kind)
            out.append(
                LogPattern(pattern, "json", name, {"name": name}, "^{", ENVELOPE_KEYS, TIMESTAMP_KEYS)
            )
    for kind, pattern in _TEXT_LOGS:
        if on[kind].get("text"):
            name = _NAMES.get(kind, kind)
            out.append(
                LogPattern(
                    pattern, "multiline", name, {"name": name}, r"^\[", timestamp_patterns=SEARCH_LOG_TIMESTAMPS
                )
            )
    return out


def usable(patterns: Sequence[LogPattern]) -> list[LogPattern]:
    return [p for p in patterns if p.pattern]


def pattern_index(path: Column | str, patterns: Sequence[LogPattern]) -> Column:
    """Position of the first pattern matching the base name; null when none does."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(c, "/"), -1)
    chain: Column | None = None
    for i, p in enumerate(usable(patterns)):
        hit = matches(name, p.pattern)
        chain = F.when(hit, F.lit(i)) if chain is None else chain.when(hit, F.lit(i))
    return chain if chain is not None else F.lit(None).cast("int")


def route_files(listing: DataFrame, patterns: Sequence[LogPattern], name: str = "path") -> DataFrame:
    """Keep the files some pattern wants and say which one comes first.

    The few patterns are constants of the plan, so routing is a projection.
    """
    from ..operators.envelope import object_literal

    wanted = usable(patterns)
    index = F.col("pattern_index")
    routed = listing.withColumn("pattern_index", pattern_index(name, wanted)).filter(index.isNotNull())
    if not wanted:
        return routed.withColumns({"log_type": F.lit(""), "log_name": F.lit(""), "pattern_metadata": F.lit(None).cast(OBJECT)})
    return routed.withColumns(
        {
            "log_type": F.get(F.array(*[F.lit(p.type) for p in wanted]), index),
            "log_name": F.get(F.array(*[F.lit(p.name) for p in wanted]), index),
            "pattern_metadata": F.get(F.array(*[object_literal(p.metadata) for p in wanted]), index),
        }
    )
