"""Pattern predicates, cheapest form first.

A pattern that is only literals becomes ``contains`` / ``startswith`` /
``isin`` / ``=``, which Spark evaluates without a regex engine and can push to
the scan; anything else becomes ``rlike``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import escape_braces, to_java

_LITERAL = re.compile(r"(?:[^\\.+*?()|\[\]{}^$]|\\[^A-Za-z0-9])+")
_DATE = re.compile(r"\^(?:[^\\.+*?()|\[\]{}^$]|\\[^A-Za-z0-9])*(?:(?:\(\\d\{\d+\}\)|\\d)(?:\{\d+\})?[-:/., T_]*)+(?:[^\\.+*?()|\[\]{}^$])*")


def _plain(text: str) -> str | None:
    """The text a literal pattern stands for, or None."""
    return re.sub(r"\\(.)", r"\1", text) if _LITERAL.fullmatch(text) else None


def _alternatives(text: str) -> list[str] | None:
    inner = re.fullmatch(r"\((?:\?:)?(.*)\)", text, re.S)
    parts = [_plain(p) for p in (inner.group(1) if inner else text).split("|")]
    return parts if len(parts) > 1 and None not in parts else None


def describe(pattern: str, exact: bool = False) -> tuple[str, list[str]]:
    """Name the predicate for ``pattern`` and the literals it needs."""
    body = escape_braces(pattern)
    if exact:
        if not (body.startswith("(") or "|" in body):
            body = "^" + body.removeprefix("^")
            body = body if body.endswith("$") and not body.endswith("\\$") else body + "$"
        else:
            body = f"^(?:{body})$"
    while body.startswith("^.*"):
        body = body[3:]
    while body.startswith(".*"):
        body = body[2:]
    while body.endswith((".*$", ".*")) and not body.endswith(("\\.*$", "\\.*")):
        body = body[: -3 if body.endswith("$") else -2]
    if body in ("", "$"):
        return "any", []
    if body == "^$":
        return "empty", []
    if body in (r"^\s*$", r"^[\s]*$"):
        return "blank", []
    anchored, closed = body.startswith("^"), body.endswith("$") and not body.endswith("\\$")
    core = body[1 if anchored else 0 : len(body) - (1 if closed else 0)]
    literal, options = _plain(core), _alternatives(core)
    if "|" in core and not core.startswith("(") and (anchored or closed):
        options = None
    if literal is not None:
        if anchored and closed:
            return "equals", [literal]
        if anchored:
            return "prefix", [literal]
        if not closed:
            return "contains", [literal]
    if options:
        if anchored and closed:
            return "one_of", options
        if anchored:
            return "any_prefix", options
        if not closed:
            return "any_contains", options
    if not closed and _DATE.fullmatch(body):
        return "date_prefix", []
    return "regex", []


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def matches(column: Column | str, pattern: str, exact: bool = False) -> Column:
    """True where the text contains a match (or, if ``exact``, is one)."""
    c = F.col(column) if isinstance(column, str) else column
    kind, literals = describe(pattern, exact)
    if kind == "any":
        return c.isNotNull()
    if kind == "empty":
        return c == ""
    if kind == "equals":
        return c == literals[0]
    if kind == "prefix":
        return c.startswith(literals[0])
    if kind == "contains":
        return c.contains(literals[0])
    if kind == "one_of":
        return c.isin(literals)
    if kind == "any_prefix":
        return _any([c.startswith(x) for x in literals])
    if kind == "any_contains":
        return _any([c.contains(x) for x in literals])
    return c.rlike(to_java(f"^(?:{pattern})$" if exact else pattern))


def contains_text(column: Column | str, text: str) -> Column:
    """Plain substring; an empty needle stands for the empty string only."""
    c = F.col(column) if isinstance(column, str) else column
    return c == "" if text == "" else c.contains(text)


def matches_any(column: Column | str, pattern: str, exact: bool = False) -> Column:
    """True where any text of an array matches; false on an empty array."""
    return F.exists(column, lambda x: F.coalesce(matches(x, pattern, exact), F.lit(False)))


def matches_all(column: Column | str, pattern: str, exact: bool = False) -> Column:
    """True where all texts of an array match; true on an empty array."""
    return F.forall(column, lambda x: F.coalesce(matches(x, pattern, exact), F.lit(True)))
