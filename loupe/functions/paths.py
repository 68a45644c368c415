"""Paths, globs, routes and module names as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A route segment that is a parameter, and the scheme and host of a URL (fixed patterns).
PARAMETER, ORIGIN = r"^(\{.*\}|:.+|<.+>|\*.*)$", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*"


def glob_regex(glob: str) -> str:
    """A doublestar glob as a regular expression for whole slash-separated paths."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i) and i + 2 == len(glob) and (i == 0 or glob[i - 1] == "/"):
            if i:
                out[-1] = "(?:/.*)?"
                i += 2
                continue
            out.append(".*")
            i += 2
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def matches_any(path: Column, globs: list[str]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def normalise_route(raw: Column) -> Column:
    """A route or URL as /segments with parameters as *; NULL if it isn't a path."""
    path = F.regexp_replace(F.regexp_replace(F.trim(raw), ORIGIN, ""), r"[?#].*$", "")
    path = F.regexp_replace(path, r"^\{\}", "")
    bare = F.regexp_replace(F.regexp_replace(path, r"\{\$\}", ""), "/$", "")
    segments = F.split(F.regexp_replace(bare, "^/", ""), "/")
    starred = F.transform(segments, lambda s: F.when(s.rlike(PARAMETER) | s.contains("{}"), "*").otherwise(s))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(starred, "/")))


def has_literal(route: Column) -> Column:
    """Whether a request path has a segment that is no parameter; others would match every route."""
    return F.exists(F.split(F.regexp_replace(route, "^/", ""), "/"), lambda s: (s != "*") & (s != ""))


def module_of(path: Column) -> Column:
    """The module of a file: its path without extension and a leading src/ or lib/; a package for __init__."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^(src|lib)/", ""), r"\.[^./]+$", "")
    return F.regexp_replace(bare, r"(^|/)__init__$", "")


def ancestors(path: Column) -> Column:
    """The path and all directories above it, longest first; the root is (root)."""
    parts = F.split(path, "/")
    return F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")), F.array(F.lit("(root)")))


def shared_tail(a: Column, b: Column) -> Column:
    """How many path components two paths share from their ends."""
    left, right = F.reverse(F.split(a, "/")), F.reverse(F.split(b, "/"))
    same = F.zip_with(F.slice(left, 1, F.least(F.size(left), F.size(right))), F.slice(right, 1, F.least(F.size(left), F.size(right))), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def clean_path(path: Column) -> Column:
    """A path with / as its only separator, without file://, empty and . components, and with .. taken back where something stands before it."""
    bare = F.regexp_replace(F.translate(path, "\\", "/"), "^file://", "")
    rooted = bare.startswith("/")
    parts = F.filter(F.split(bare, "/"), lambda x: (x != "") & (x != "."))

    def step(held: Column, x: Column) -> Column:
        back = (F.size(held) > 0) & (F.element_at(held, -1) != "..")
        return F.when(x != "..", F.concat(held, F.array(x))).when(back, F.slice(held, 1, F.size(held) - 1)).when(rooted, held).otherwise(F.concat(held, F.array(x)))

    plain = F.array_join(F.when(F.array_contains(parts, ".."), F.aggregate(parts, F.array().cast("array<string>"), step)).otherwise(parts), "/")
    return F.when(rooted, F.concat(F.lit("/"), plain)).when(plain == "", ".").otherwise(plain)


def relative_key(root: str, path: Column) -> Column:
    """An absolute path as snapshots name it: below root relative to it, elsewhere as it is; slashes only."""
    base, plain = root.rstrip("/"), clean_path(path)
    return F.when(plain == base, ".").when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2))).otherwise(plain)
