"""JSON logs: decoding, lifting and merging of objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import (
    OBJECT,
    as_text,
    first_object,
    is_text,
    lookup,
    parse_object,
    put,
    remove_fields,
    text_value,
    update,
)
from ..functions.once import once
from .assemble import MAX_BYTES, assemble


def read_json_events(
    lines: DataFrame, start: str = "^{", max_bytes: int = MAX_BYTES, offsets: bool = False
) -> DataFrame:
    """Assemble events that begin with ``{`` and parse each to ``json``.

    Rows whose text is no single object keep ``json`` null; ``accepted`` and
    ``rejected`` split them, so that offsets still advance over bad events.
    """
    # The assembly already holds events to the limit.
    events = assemble(lines, start, max_bytes=max_bytes, offsets=offsets)
    return once(events, "json", parse_object("content"))


def accepted(events: DataFrame) -> DataFrame:
    return events.filter(F.col("json").isNotNull())


def rejected(events: DataFrame) -> DataFrame:
    return events.filter(F.col("json").isNull()).drop("json")


# The three error texts.
NO_OBJECT = "Error decoding JSON"
NO_KEY = "Key '{}' not found"
NO_STRING = "Value of key '{}' is not a string"


def _error(message: Column) -> Column:
    return F.to_variant_object(F.struct(message.alias("message"), F.lit("json").alias("type")))


def decode_json(
    df: DataFrame,
    message_key: str | None = None,
    add_error_key: bool = False,
    column: str = "content",
) -> DataFrame:
    """Decode the object in ``column`` to ``json``; ``content`` becomes the message.

    The message is the string under ``message_key``, empty when there is none,
    or the untouched text when decoding failed. ``add_error_key`` records what
    went wrong under ``error``. A failed row without it has ``json`` null, which
    callers may count or drop.
    """
    df = once(df, "_object", first_object(column))
    obj, failed = F.col("_object"), F.col("_object").isNull()
    json = obj
    if not message_key:
        content = F.when(failed, F.col(column)).otherwise(F.lit(""))
        problem = F.lit(None).cast("string")
    else:
        value = obj[message_key]
        has_key = F.map_contains_key(obj, message_key)
        content = F.when(failed, F.col(column)).otherwise(F.coalesce(as_text(value), F.lit("")))
        problem = F.when(~has_key, F.lit(NO_KEY.format(message_key))).when(
            ~is_text(value), F.lit(NO_STRING.format(message_key))
        )
    if add_error_key:
        problem = F.when(failed, F.lit(NO_OBJECT)).otherwise(problem)
        base = F.coalesce(obj, F.create_map().cast(OBJECT))
        json = F.when(problem.isNotNull(), put(base, "error", _error(problem))).otherwise(obj)
    return df.withColumns({"json": json, "content": content}).drop("_object")


def decode_json_field(
    df: DataFrame,
    field: str = "content",
    target: str = "json",
    message_key: str | None = None,
    add_error_key: bool = False,
    document_id: str | None = None,
) -> DataFrame:
    """As ``decode_json`` from a chosen column into ``target``.

    The message key is refreshed from the content, and a row left with nothing
    but an error keeps its raw text as ``message``.
    """
    if field not in df.columns:
        raise ValueError(f"cannot decode JSON message, missing key: {field}")
    df = decode_json(df, message_key, add_error_key, field)
    json = F.col("json")
    if message_key:
        json = F.when(
            (F.cardinality(json) > 0) & (F.length("content") > 0), put(json, message_key, text_value(F.col("content")))
        ).otherwise(json)
    df = df.withColumn("json", json)
    only_error = (F.cardinality("json") == 1) & F.map_contains_key("json", "error")
    df = df.withColumn("message", F.when(only_error, F.col("content")))
    if document_id:
        df = lift_document_id(df, document_id)
    return df if target == "json" else df.withColumnRenamed("json", target)


def lift_document_id(df: DataFrame, key: str, column: str = "json") -> DataFrame:
    """Move the string at ``key`` to ``document_id``; other types stay in place."""
    found = as_text(lookup(column, key))
    head, *rest = key.split(".")
    literal = F.map_filter(column, lambda k, v: k != key)
    nested = remove_fields(F.col(column), [key]) if rest else literal
    without = F.when(F.map_contains_key(column, key), literal).otherwise(nested)
    return df.withColumn("document_id", found).withColumn(
        column, F.when(F.col("document_id").isNotNull(), without).otherwise(F.col(column))
    )


def merge_json(
    df: DataFrame,
    root: str = "fields",
    column: str = "json",
    keys_under_root: bool = True,
    overwrite_keys: bool = False,
    expand_keys: bool = False,
) -> DataFrame:
    """Lift decoded keys into the ``root`` map and drop ``json`` and ``@timestamp`` there.

    ``overwrite_keys`` lets decoded keys replace those at the root. A string
    ``@timestamp`` among the decoded keys becomes the column ``event_time``.
    ``expand_keys`` turns a dotted key into a nested object.
    """
    if not keys_under_root:
        return df
    decoded = expand_dotted(F.col(column)) if expand_keys else F.col(column)
    decoded = F.coalesce(decoded, F.create_map().cast(OBJECT))
    kept = F.map_filter(root, lambda k, v: ~k.isin("json", "@timestamp"))
    event_time = F.try_to_timestamp(as_text(F.col(column)["@timestamp"]))
    decoded = F.map_filter(decoded, lambda k, v: k != "@timestamp")
    base, over = (kept, decoded) if overwrite_keys else (decoded, kept)
    # A lambda argument is evaluated once; within the merge it would be, for every key.
    merged = F.get(F.transform(F.array(over), lambda o: update(base, o)), F.lit(0))
    return df.withColumns({"event_time": event_time, root: merged}).drop(column)


def expand_dotted(obj: Column) -> Column:
    """``{"a.b": 1}`` as ``{"a": {"b": 1}}``, one level per key.

    Keys sharing a head are put into one object; an existing object under the
    head keeps its own members.
    """

    def head(k: Column) -> Column:
        return F.substring_index(k, ".", 1)

    heads = F.array_distinct(F.transform(F.map_keys(obj), head))

    def build(h: Column) -> Column:
        dotted = F.transform(
            F.filter(F.map_entries(obj), lambda e: e["key"].startswith(F.concat(h, F.lit(".")))),
            lambda e: F.struct(F.substr(e["key"], F.length(h) + 2).alias("key"), e["value"].alias("value")),
        )

        def nested(entries: Column) -> Column:
            own = F.coalesce(obj[h].try_cast(OBJECT), F.create_map().cast(OBJECT))
            return F.when(F.size(entries) > 0, F.to_variant_object(update(own, F.map_from_entries(entries)))).otherwise(obj[h])

        # The argument of a lambda is evaluated once.
        value = F.get(F.transform(F.array(dotted), nested), F.lit(0))
        return F.struct(h.alias("key"), value.alias("value"))

    return F.map_from_entries(F.transform(heads, build))
