"""Wildcard patterns as regular expressions that Java, RE2 and Python read alike."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(glob: str) -> str:
    """One path segment of an ignore pattern: ``*`` and ``?`` stay inside it, and so do bracket classes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out += re.escape(glob[i + 1])
            i += 2
            continue
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            j = i + 1 + (glob[i + 1 : i + 2] in ("!", "^"))
            j = glob.find("]", j + 1)
            if j < 0:
                out += r"\["
            else:
                body = glob[i + 1 : j]
                negate = body[:1] in ("!", "^")
                body = (body[1:] if negate else body).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
                out += ("[^" if negate else "[") + body + "]"
                i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore_pattern(line: str) -> tuple[bool, str] | None:
    """``(negated, regex)`` of a line of an ignore file; None for blanks and comments.

    A pattern with a slash other than at its end is anchored at the root; one without matches at any depth. A match
    covers everything below it, and a trailing slash covers only that.
    """
    line = line.rstrip("\n").rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    line = line.lstrip(" \t") if line.strip() else ""
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    if line.startswith(("\\#", "\\!")):
        line = line[1:]
    if not line.strip("/"):
        return None
    parts = line.split("/")
    if parts[0] == "":
        parts = parts[1:]
    elif len(parts) == 1 or (len(parts) == 2 and parts[1] == ""):
        parts = ["**", *parts]
    below_only = parts[-1] == ""
    if below_only:
        parts[-1] = "**"
    flat = [p for i, p in enumerate(parts) if not (p == "**" and i and parts[i - 1] == "**")]
    regex, slash = "^", False
    for i, part in enumerate(flat):
        last = i == len(flat) - 1
        if part == "**":
            if i == 0 and last:
                regex += ".+"
            elif i == 0:
                regex += "(?:.+/)?"
                slash = False
            elif last:
                regex += "/.*" if below_only or slash else "/.*"
            else:
                regex += "(?:/.+)?"
                slash = True
            continue
        if slash:
            regex += "/"
        regex += "[^/]+" if part == "*" else _segment(part)
        slash = True
        if last:
            regex += "(?:/.*)?"
    return negated, regex + "$"


def any_match(path: Column, patterns: Iterable[str]) -> Column:
    """Whether any of the patterns covers the path; negation has no effect here, as in allow and block lists it has none."""
    found = [p[1] for p in map(ignore_pattern, patterns) if p and not p[0]]
    if not found:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{r})" for r in found))


def matches(path: str, patterns: Iterable[str]) -> bool:
    """:func:`any_match` on the driver."""
    return any(p and not p[0] and re.search(p[1], path) for p in map(ignore_pattern, patterns))


def name_pattern(glob: str) -> str:
    """A shell-style file name pattern, whose ``*`` also crosses slashes, as a regular expression for the whole path."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + (glob[i : i + 1] == "!")
            j = glob.find("]", j + 1)
            if j < 0:
                out += r"\["
            else:
                body = glob[i:j].replace("\\", "\\\\").replace("[", "\\[")
                out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
                i = j + 1
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"
