"""Glob patterns as column predicates: `*`, `?`, `[..]`, `[^..]`, ranges and `\\` escapes, anchored.

A pattern becomes an anchored regular expression, with the literal prefix as a conjunct of its own that
reaches the Parquet scan. `?` matches one code point. Class rules: without `]` a class runs to the
pattern's end; an empty class never matches and its negation matches anything; a reversed range is
swapped; an escaped character can't end a range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL = "*?[\\"


def literal_prefix(pattern: str) -> str:
    """The text every match begins with."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            c = pattern[i]
        elif c in "*?[":
            break
        out.append(c)
        i += 1
    return "".join(out)


def _literal(c: str) -> str:
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


def _class(body: list[tuple[str, bool]], negated: bool) -> str:
    """body: (character, escaped) pairs."""
    if not body:
        return "." if negated else "(?!)"
    parts, i = [], 0
    while i < len(body):
        low = body[i][0]
        if i + 2 < len(body) and body[i + 1] == ("-", False) and not body[i + 2][1]:
            high = body[i + 2][0]
            parts.append(f"{_literal(min(low, high))}-{_literal(max(low, high))}")
            i += 3
        else:
            parts.append(_literal(low))
            i += 1
    return f"[{'^' if negated else ''}{''.join(parts)}]"


def to_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            if not out or out[-1] != ".*":
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            body: list[tuple[str, bool]] = []
            while i < len(pattern) and pattern[i] != "]":
                escaped = pattern[i] == "\\" and i + 1 < len(pattern)
                i += escaped
                body.append((pattern[i], escaped))
                i += 1
            i += 1
            out.append(_class(body, negated))
        elif c == "\\" and i < len(pattern):
            out.append(_literal(pattern[i]))
            i += 1
        else:
            out.append(_literal(c))
    return r"(?s)\A" + "".join(out) + r"\z"


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    if all(c not in SPECIAL for c in pattern):
        return text == pattern
    prefix = literal_prefix(pattern)
    if pattern.endswith("*") and all(c not in SPECIAL for c in pattern[:-1]):
        return text.startswith(prefix) if prefix else text.isNotNull()
    found = text.rlike(to_regex(pattern))
    return text.startswith(prefix) & found if prefix else found
