"""RE2-style patterns for Spark's Java regex functions."""

from __future__ import annotations

import re

_POSIX = {
    "alpha": "\\p{Alpha}", "digit": "0-9", "alnum": "\\p{Alnum}", "upper": "\\p{Upper}",
    "lower": "\\p{Lower}", "punct": "\\p{Punct}", "space": "\\t\\n\\x0B\\f\\r ", "blank": " \\t",
    "xdigit": "0-9A-Fa-f", "word": "\\w", "print": "\\p{Print}", "graph": "\\p{Graph}", "cntrl": "\\p{Cntrl}",
}


def escape_braces(pattern: str) -> str:
    """A ``{`` that opens no repetition stands for itself."""
    return re.sub(r"(?<!\\)(?<!\\[pPx])\{(?!\d+(?:,\d*)?\})", r"\\{", pattern)


def to_java(pattern: str) -> str:
    """Give ``pattern`` its RE2 meaning under Java.

    ``$`` is the end of the text, ``.`` leaves out only the newline, ``\\s`` has
    no vertical tab. Look-around and back-references do not exist in RE2.
    """
    if re.search(r"(?<!\\)\(\?(?:[=!>]|<[=!])", pattern):
        raise ValueError(f"look-around is not supported: {pattern}")
    pattern = escape_braces(pattern)
    multiline = re.match(r"\(\?[a-z]*m", pattern) is not None
    out = ["(?d)"]
    i, in_class = 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n.isdigit() and n != "0" and not in_class:
                raise ValueError(f"back-references are not supported: {pattern}")
            if n == "s":
                out.append("\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]")
            elif n == "S" and not in_class:
                out.append("[^\\t\\n\\f\\r ]")
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class:
            named = re.match(r"\[:(\^?)(\w+):\]", pattern[i:])
            if named and named.group(2) in _POSIX:
                body = _POSIX[named.group(2)]
                out.append(f"[^{body}]" if named.group(1) else body)
                i += named.end()
                continue
            if c == "]":
                in_class = False
            elif c == "[" or pattern.startswith("&&", i):
                out.append("\\")
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern.startswith("^", i + 1):
                out.append("^")
                i += 1
            if pattern.startswith("]", i + 1):
                out.append("\\]")
                i += 1
        elif c == "$" and not multiline:
            out.append("\\z")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        else:
            out.append(c)
        i += 1
    return "".join(out)
