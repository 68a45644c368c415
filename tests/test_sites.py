"""Mutation sites, their offsets and unit hashes: what a comment changes (nothing) and what else does."""

import re

import pytest

from loupe.operators import sites

RULES = [("literal", "true", "true", "false"), ("literal", "number", "0", "1"), ("swap", "binary", "+", "-"), ("swap", "binary", "<", "<="), ("delete", "unary", "!", None), ("left", "ternary", "?", None), ("delete", "binary", "*", None)]
BASE = "func f() {\n\tx := a + 0\n\tif !b {\n\t\treturn true\n\t}\n}"
COMMENTED = {
    "own lines": "func f() { \n\t// one\n\tx := a + 0\n\t/* two\n\tlines */\n\tif !b {\n\t\treturn true\n\t}\n}".replace("{ \n", "{\n"),
    "ends": "func f() {\n\tx := a + 0 // sum\n\tif !b { // not\n\t\treturn true\n\t} /* end */\n}",
    "starts and between": "func f() {\n\t/* s */ x := a /* m */ + 0\n\tif !b {\n\t\treturn true // t\n\t}\n}",
    "two at once": "func f() {\n\tx := a + 0 /* a */ // b\n\tif !b {\n\t\treturn true\n\t}\n}",
}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


def frames(spark, sources):
    """units, comments, contents and tokens of files that are one unit after a first line."""
    units, comments, contents, tokens = [], [], [], []
    for file, source in sources.items():
        text = "package p\n" + source + "\n"
        start = len("package p\n")
        units.append((file, 0, start, start + len(source)))
        contents.append((file, text.encode()))
        held = [m.span() for m in re.finditer(r"//[^\r\n]*|/\*.*?\*/", text, re.S)]
        comments += [(file, 0, a, b) for a, b in held]
        for m in re.finditer(r"\btrue\b|\b0\b|[+!]", text):
            if not any(a <= m.start() < b for a, b in held):
                kind, parent = {"true": ("true", "block"), "0": ("number", "binary"), "+": ("+", "binary"), "!": ("!", "unary")}[m[0]]
                tokens.append((file, 0, m.start(), m.end(), kind, m[0], m[0] in ("true", "0"), parent, m.start() - 2))
    make = spark.createDataFrame
    span = "file string, unit int, start bigint, end bigint"
    return make(units, span), make(comments, span), make(contents, "file string, content binary"), make(tokens, f"{span}, kind string, text string, named boolean, parent_kind string, parent_start bigint")


def test_comments_change_nothing(spark):
    units, comments, contents, tokens = frames(spark, {"base": BASE} | COMMENTED | {"crlf": BASE.replace("\n", "\r\n"), "crlf comments": COMMENTED["own lines"].replace("\n", "\r\n"), "space": BASE.replace("a + 0", "a +  0")})
    cuts = sites.comment_cuts(units, comments, contents).cache()
    none = units.limit(0)
    hashes = {r["file"]: r["hash"] for r in sites.code_hash(units, contents, none, cuts).collect()}
    assert {hashes[f] for f in COMMENTED} == {hashes["base"]} and hashes["crlf"] == hashes["crlf comments"] and len({hashes[f] for f in ("base", "crlf", "space")}) == 3
    before = {r["file"]: r["hash"] for r in sites.code_hash(units, contents, none).collect()}
    assert before["base"] == hashes["base"] and len({before[f] for f in COMMENTED}) == len(COMMENTED)
    found = sites.find(tokens, spark.createDataFrame(RULES, "rule string, kind string, text string, replacement string"))
    placed = sites.offsets(found, units, cuts)
    of = lambda f: rows(placed.where(placed["file"] == f), "offset", "replacement")
    assert len(of("base")) == 4 and all(of(f) == of("base") for f in COMMENTED) and of("crlf") == of("crlf comments") != of("base")


def test_cases_of_rules(spark):
    rules = spark.createDataFrame([*RULES, ("swap", "compare", None, None)], "rule string, kind string, text string, replacement string")
    token = "file string, unit int, start bigint, end bigint, kind string, text string, named boolean, parent_kind string, parent_start bigint"
    tokens = [
        ("a", 0, 1, 2, "number", "7", True, "binary", 0), ("a", 0, 2, 3, "number", "0", True, None, None), ("a", 0, 3, 4, "*", "*", False, "binary", 0), ("a", 0, 4, 5, "<", "<", False, "binary", 0), ("a", 0, 5, 6, "<", "<", True, "binary", 0),
        ("a", 0, 6, 7, "!", "!", False, "unary", 6), ("a", 0, 7, 8, "?", "?", False, "ternary", 2), ("a", 0, 8, 9, "?", "!", False, "ternary", 2), ("a", 0, 9, 10, "+", "+", False, "compare", 2), ("a", 0, 10, 11, "+", None, None, None, None),
    ]
    # a literal without a replacement has none; an operator of a swapping parent isn't deleted; a left deletion starts with its parent
    assert rows(sites.find(spark.createDataFrame(tokens, token), rules), "start", "end", "replacement") == [(2, 3, "1"), (2, 8, ""), (4, 5, "<="), (6, 7, "")]


@pytest.mark.parametrize(("text", "comment", "want"), [
    ("a // c\nb", (2, 6), [(1, 6)]), ("// c\nb", (0, 4), [(0, 5)]), ("a\n  // c", (4, 8), [(1, 8)]), ("a\r\n// c", (3, 7), [(1, 7)]), ("// c", (0, 4), [(0, 4)]), ("a /* c */ b", (2, 9), [(1, 9)]), ("/* c */ b", (0, 7), [(0, 8)]), ("a // c\r\nb", (2, 7), [(1, 6)]), ("a", (1, 1), []),
])
def test_cut(text, comment, want):
    assert sites._cut(text.encode(), 0, len(text), [comment]) == want


def test_inline_units_and_nothing(spark):
    span = "file string, unit int, start bigint, end bigint"
    units = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 3, 6), ("b", 0, 0, 0), ("none", 0, 0, 5)], span)
    contents = spark.createDataFrame([("a", b"abcDEFghij"), ("b", b"")], "file string, content binary")
    inline = spark.createDataFrame([("a", 0, 3, 6), ("a", 0, 4, 5), ("a", 0, 9, 30)], span)
    import hashlib

    short = lambda b: hashlib.sha256(b).hexdigest()[:16]
    assert rows(sites.code_hash(units, contents, inline)) == [("a", 0, short(b"abcghi")), ("a", 1, short(b"DEF")), ("b", 0, short(b""))]
    assert sites.comment_cuts(units, units.limit(0), contents).count() == 0
    assert rows(sites.offsets(units.where("unit = 1"), units, units.limit(0)), "offset") == [(0,)]
