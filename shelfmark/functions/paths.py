"""Path predicates and transforms as Columns; patterns are compiled on the driver."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Usage


def glob_regex(pattern: str) -> str | None:
    """Regular expression, for Java and Python, of a glob over one path level; None if malformed."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i == len(pattern):
                return None
            out += _quoted(pattern[i])
            i += 1
        elif c == "[":
            negated = pattern[i : i + 1] == "^"
            i += negated
            parts, first = [], True
            while True:
                if i >= len(pattern):
                    return None
                if pattern[i] == "]" and not first:
                    i += 1
                    break
                first = False
                low, i = _member(pattern, i)
                high = low
                if low is not None and pattern[i : i + 1] == "-":
                    high, i = _member(pattern, i + 1)
                if low is None or high is None:
                    return None
                if low <= high:
                    parts.append(_quoted(low) if low == high else f"{_quoted(low)}-{_quoted(high)}")
            body = "".join(parts)
            # a class never takes the separator
            out += (f"[^/{body}]" if negated else f"(?!/)[{body}]") if body else ("[^/]" if negated else "(?!)")
        else:
            out += _quoted(c)
    return out


def _member(pattern: str, i: int) -> tuple[str | None, int]:
    if i < len(pattern) and pattern[i] == "\\":
        i += 1
    elif i < len(pattern) and pattern[i] in "-]":
        return None, i
    return (pattern[i], i + 1) if i < len(pattern) else (None, i)


def _quoted(c: str) -> str:
    return "\\" + c if not c.isalnum() and ord(c) < 128 else c


def _whole(expression: str) -> str:
    return rf"(?s)\A(?:{expression})\z"


def ancestors(path: Column, itself: bool = True) -> Column:
    """The path's directories from the top, and the path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)) if itself else F.slice(F.sequence(F.lit(1), F.size(parts)), 1, F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def matches(path: Column, pattern: str) -> Column:
    """The pattern is everything (empty or dot), the path, a directory above it, a glob of
    the whole path or, without a slash, of any component. Malformed globs match literally."""
    pattern = posixpath.normpath(pattern) if pattern else "."
    pattern = pattern.rstrip("/") or "/"
    if pattern == ".":
        return F.lit(True)
    found = (path == pattern) | path.startswith(pattern + "/")
    regex = glob_regex(pattern)
    if regex is not None and re.search(r"[*?\[\\]", pattern):
        found = found | path.rlike(_whole(regex))
    if regex is not None and "/" not in pattern:
        found = found | F.exists(F.split(path, "/"), lambda c: c.rlike(_whole(regex)))
    return found


def matcher(patterns: list[str]):
    """``matches_any`` as a function of one path, for walks on the driver."""
    tests = []
    for pattern in patterns:
        clean = (posixpath.normpath(pattern) if pattern else ".").rstrip("/") or "/"
        regex = glob_regex(clean)
        tests.append((clean, re.compile(regex, re.S) if regex is not None else None))

    def one(path: str) -> bool:
        for clean, regex in tests:
            if clean == "." or path == clean or path.startswith(clean + "/"):
                return True
            if regex and (regex.fullmatch(path) or ("/" not in clean and any(map(regex.fullmatch, path.split("/"))))):
                return True
        return False

    return one


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [matches(path, p) for p in patterns], F.lit(False))


def matches_any_or_parent(path: Column, patterns: list[str]) -> Column:
    return F.exists(ancestors(path), lambda p: matches_any(p, patterns)) if patterns else F.lit(False)


def check_expression(expression: str) -> str:
    """Refuses what a linear-time engine can't run or what isn't an expression by itself."""
    try:
        re.compile(expression)
    except re.error as error:
        raise Usage(f"not a regular expression: {expression}: {error}") from None
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9]|\(\?(?:=|!|<=|<!|P=|>)|\\k<", expression):
        raise Usage(f"backreferences and look-around aren't supported: {expression}")
    return expression


def regex_matches(path: Column, expression: str) -> Column:
    """The whole path, newlines included; contents of a matching directory don't match."""
    return path.rlike(_whole(check_expression(expression)))


def regex_matches_or_parent(path: Column, expressions: list[str]) -> Column:
    each = [_whole(check_expression(e)) for e in expressions]
    return F.exists(ancestors(path), lambda p: reduce(lambda a, b: a | b, [p.rlike(e) for e in each])) if each else F.lit(False)


def store_path(path: Column) -> Column:
    """Cleaned relative path: no leading slash, no empty, dot or dot-dot component."""
    step = lambda done, c: F.when(c.isin("", "."), done).when(c == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, c))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(F.size(parts) == 0, ".").otherwise(F.array_join(parts, "/"))


def is_stripped(path: Column) -> Column:
    """Whether ``store_path`` takes a leading slash or a dot-dot component away."""
    return path.startswith("/") | F.exists(F.split(path, "/"), lambda c: c == "..")


def is_stored_path(path: Column) -> Column:
    return (path == ".") | F.forall(F.split(path, "/"), lambda c: ~c.isin("", ".", ".."))


def strip(path: Column, n: int) -> Column:
    """Without its first n components; null if nothing is left."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, n + 1, F.greatest(F.size(parts) - n, F.lit(1))), "/"))
