"""What a regular expression's matches are bound to hold, so that a plain search can spare the expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, those of its outermost groups without quantifier included."""
    parts, depth, start, in_class, i = [], 0, 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def literal(alternative: str) -> str | None:
    """The longest run of plain characters, in lower case, that every match of an alternative holds outside of groups and classes."""
    runs, run, i, depth = [], "", 0, 0
    text = alternative.removeprefix("(?i)")
    while i < len(text):
        c, plain = text[i], None
        if c == "\\":
            i += 1
            plain = text[i] if not text[i].isalnum() else None
            if text[i : i + 1] in ("x", "p", "P") and text[i + 1 : i + 2] == "{":
                i = text.index("}", i)
        elif c == "[":
            i = text.index("]", i + 2)
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "{":
            i = text.index("}", i)
        elif c not in ".^$?*+|":
            plain = c
        optional = text[i + 1 : i + 2] in ("?", "*") or text[i + 1 : i + 3] == "{0"
        if plain is not None and depth == 0 and not optional:
            run += plain
        else:
            runs.append(run)
            run = ""
        i += 1
    best = max([*runs, run], key=len)
    return best.lower() if len(best) >= 2 else None


def may_match(low: Column, text: Column, patterns: list[str]) -> Column:
    """Whether a text can match any of the patterns: by the literals in its lower-case form `low`, or by the pattern itself where it has none."""
    tests = []
    for pattern in patterns:
        keys = [literal(a) for a in alternatives(pattern)]
        tests += [text.rlike("(?m)" + pattern)] if None in keys else [low.contains(k) for k in dict.fromkeys(keys)]
    return reduce(lambda a, b: a | b, tests)
