"""Free-form JSON objects as ``map<string,variant>``.

The map keeps literal dotted keys, nulls and long integers; nested objects stay
variants until a path is asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "map<string,variant>"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def parse_object(text: Column | str) -> Column:
    """The object a text consists of; null when it is anything else.

    ``from_json`` stops after the first value, so the text is read as the only
    element of an array. A text that itself closes the array is told apart by
    reading it a second time as a member value; only texts with ``]`` pay that.
    """
    c = _col(text)
    items = F.from_json(F.concat(F.lit("["), c, F.lit("]")), f"array<{OBJECT}>", _STRICT)
    member = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), OBJECT, _STRICT)
    # A lambda argument is evaluated once, so the text is read once.
    only = F.filter(
        F.array(items), lambda a: (F.size(a) == 1) & (~c.contains("]") | member.isNotNull())
    )
    return F.get(F.get(only, F.lit(0)), F.lit(0))


def first_object(text: Column | str) -> Column:
    """The object a text begins with; what follows it is ignored."""
    return F.from_json(_col(text), OBJECT, _STRICT)


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def as_text(value: Column) -> Column:
    """The string a variant holds; null for any other type."""
    return F.when(is_text(value), F.try_variant_get(value, "$", "string"))


def lookup(obj: Column | str, key: str) -> Column:
    """Value under the literal key, else under the dotted path."""
    m = _col(obj)
    head, *rest = key.split(".")
    if not rest:
        return m[key]
    path = "$" + "".join(f"['{p}']" for p in rest)
    return F.coalesce(m[key], F.try_variant_get(m[head], path, "variant"))


def update(base: Column | str, over: Column | str) -> Column:
    """Shallow merge; keys of ``over`` win."""
    b, o = _col(base), _col(over)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(o, k)), o)


def put(obj: Column | str, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(_col(obj), lambda k, v: k != key), F.create_map(F.lit(key), value))


def text_value(value: Column) -> Column:
    return value.cast("string").cast("variant")


def _without_paths(obj: Column, paths: Sequence[Sequence[str]], level: int) -> Column:
    """Drop nested paths in one walk; values that are no objects stay as they are."""
    leaves = [p[0] for p in paths if len(p) == 1]
    deeper: dict[str, list[Sequence[str]]] = {}
    for p in paths:
        if len(p) > 1:
            deeper.setdefault(p[0], []).append(p[1:])
    if leaves:
        obj = F.map_filter(obj, lambda k, v: ~k.isin(leaves))
    if deeper:

        def edit(k: Column, v: Column) -> Column:
            out = v
            for name, tails in deeper.items():
                inner = _without_paths(v.try_cast(OBJECT), tails, level + 1)
                out = F.when(k == name, F.coalesce(F.to_variant_object(inner), out)).otherwise(out)
            return out

        obj = F.transform_values(obj, edit)
    return obj


def remove_fields(obj: Column | str, keys: Iterable[str]) -> Column:
    """Drop each key both as a literal key and as a nested path."""
    keys = list(keys)
    if not keys:
        return _col(obj)
    literal = F.map_filter(_col(obj), lambda k, v: ~k.isin(keys))
    nested = [k.split(".") for k in keys if "." in k]
    return _without_paths(literal, nested, 0) if nested else literal


def pick_text(obj: Column | str, keys: Iterable[str]) -> Column:
    """First listed key whose value is a non-empty string."""
    found = [F.nullif(as_text(lookup(obj, k)), F.lit("")) for k in keys]
    return F.coalesce(*found) if found else F.lit(None).cast("string")
