"""Timestamp extraction, parsing and letter-pattern formatting."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import to_java

# The patterns tried, in order, on search-engine text logs.
SEARCH_LOG_TIMESTAMPS = (
    r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}.\d{3}\+\d{4}",
    r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2},\d{3}",
    r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2},\d{3}",
)

# Fraction letters of the named precisions.
PRECISIONS = {"millisecond": "fff", "microsecond": "ffffff", "nanosecond": "fffffffff"}

_STRICT = r"^\d{4}-\d\d-\d\dT\d{1,2}:\d\d:\d\d\.(?:\d{3}|\d{6}|\d{9})Z\z"
RFC3339 = r"^\d{4}-\d\d-\d\dT\d{1,2}:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:\d\d)\z"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def extract_timestamp(message: Column | str, patterns: Sequence[str]) -> Column:
    """The match of the first pattern, in list order, found in the message."""
    usable = [p for p in patterns if p]
    if not usable:
        return F.lit(None).cast("string")
    found = [F.regexp_substr(_col(message), F.lit(to_java(p))) for p in usable]
    return F.coalesce(*found)


def parse_timestamp(text: Column | str) -> Column:
    """UTC timestamp from text with 3, 6 or 9 fraction digits and ``Z``; else null."""
    c = _col(text)
    return F.when(c.rlike(_STRICT), F.try_to_timestamp(c))


def parse_rfc3339(text: Column | str) -> Column:
    """Timestamp from RFC 3339 text, any number of fraction digits; else null."""
    c = _col(text)
    return F.when(c.rlike(RFC3339), F.try_to_timestamp(F.translate(c, ",", ".")))


def _number(value: Column, count: int, widest: int) -> Column:
    text = value.cast("string")
    return text if count <= 1 else F.lpad(text, max(count, widest), "0")


def _fraction(nanos: Column, count: int) -> Column:
    """Fraction digits with zero groups of three dropped from the end."""
    digits = F.substring(nanos, 1, min(count, 9))
    if count <= 3:
        return digits
    needed = F.ceil(F.length(F.rtrim(digits, F.lit("0"))) / 3) * 3
    return F.left(digits, F.least(F.lit(min(count, 9)), F.greatest(F.lit(3), needed)).cast("int"))


def _letter(t: Column, nanos: Column, offset: Column, letter: str, count: int) -> Column:
    hour = F.hour(t)
    half = hour % 12
    if letter in "yYx":
        year = F.extract(F.lit("YEAROFWEEK"), t) if letter == "x" else F.year(t)
        return F.lpad((year % 100).cast("string"), 2, "0") if count == 2 else _number(year, count, 4)
    numbers = {
        "w": (F.weekofyear(t), 2),
        "e": (F.dayofweek(t) - 1, 1),
        "D": (F.dayofyear(t), 3),
        "d": (F.dayofmonth(t), 2),
        "K": (half, 2),
        "h": (half + 1, 2),
        "H": (hour, 2),
        "k": (hour + 1, 2),
        "m": (F.minute(t), 2),
        "s": (F.second(t), 2),
    }
    if letter in numbers:
        return _number(numbers[letter][0], count, numbers[letter][1])
    if letter == "M":
        if count <= 2:
            return _number(F.month(t), count, 2)
        return F.date_format(t, "MMMM" if count > 3 else "MMM")
    if letter == "E":
        return F.date_format(t, "EEEE" if count > 3 else "EEE")
    if letter == "a":
        return F.when(hour < 12, F.lit("AM")).otherwise(F.lit("PM"))
    if letter == "S":
        digits = F.substring(nanos, 1, min(count, 9))
        return F.rpad(digits, count, "0") if count > 9 else digits
    if letter == "f":
        return _fraction(nanos, count)
    if letter == "n":
        return nanos
    if letter == "z":
        size = F.abs(offset)
        return F.concat(
            F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")),
            F.lpad(F.floor(size / 3600).cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad(F.floor(size % 3600 / 60).cast("string"), 2, "0"),
        )
    raise ValueError(f"unsupported format letter {letter!r}")


def format_timestamp(ts: Column | str, pattern: str, zone: str = "UTC") -> Column:
    """Format with the letters ``x y Y w e E D M d a K h H k m s S f n z``.

    ``h`` and ``k`` count hours from 1, ``e`` counts Sunday as 0, ``S`` cuts the
    fraction, ``f`` also drops trailing zero groups, ``n`` prints nine digits.
    Text in single quotes is copied.
    """
    at = _col(ts).cast("timestamp")
    local = at if zone == "UTC" else F.from_utc_timestamp(at, zone)
    offset = F.unix_timestamp(local) - F.unix_timestamp(at)
    micros = F.lpad(F.pmod(F.unix_micros(at), F.lit(1_000_000)).cast("string"), 6, "0")
    nanos = F.concat(micros, F.lit("000"))
    parts: list[Column] = []
    for letters, text in _tokens(pattern):
        parts.append(_letter(local, nanos, offset, letters[0], len(letters)) if letters else F.lit(text))
    return F.concat(*parts) if parts else F.lit("")


def _tokens(pattern: str):
    """Letter runs and literal texts, as pairs with one side set."""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "'":
            end = pattern.find("'", i + 1)
            if end < 0:
                raise ValueError("missing closing quote")
            text = pattern[i + 1 : end] or "'"
            i = end + 1
            yield None, text
        elif c.isascii() and c.isalpha():
            run = re.match(re.escape(c) + "+", pattern[i:]).group()
            i += len(run)
            yield run, None
        else:
            i += 1
            yield None, c


def timestamp_layout(precision: str = "millisecond", local: bool = False) -> str:
    """The letter pattern of a named precision, in UTC or with an offset."""
    if precision not in PRECISIONS:
        raise ValueError(f"precision must be one of {sorted(PRECISIONS)}")
    return f"yyyy-MM-dd'T'HH:mm:ss.{PRECISIONS[precision]}" + ("z" if local else "'Z'")


def decode_ipv4(value: Column | str, order: str = "big") -> Column:
    """Dotted quad of a 32-bit number; ``little`` is the socket table's order."""
    if order not in ("big", "little"):
        raise ValueError("order must be 'big' or 'little'")
    c = _col(value).cast("bigint")
    shifts = (24, 16, 8, 0) if order == "big" else (0, 8, 16, 24)
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("string") for s in shifts])
