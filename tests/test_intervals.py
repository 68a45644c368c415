"""Sweeps over nested spans, own code, statement lines and the parser on long and deep input."""

import random
import time

import pytest

from loupe.operators import intervals, syntax
from loupe.sources import python_code

SPANS, POINTS = "file string, low int, high int, id int", "file string, pre int, depth string"


def tree(r, n):
    """Nested spans of pre-order numbers."""
    spans, open_ = [], []
    for pre in range(n):
        while open_ and r.random() < 0.4:
            spans.append((open_.pop(), pre - 1))
        open_.append(pre)
    return spans + [(a, n - 1) for a in open_]


@pytest.mark.parametrize("own", [True, False])
def test_innermost_and_outside(spark, own):
    r = random.Random(3)
    spans = [(f, a, b, i) for f in ("a", "b") for i, (a, b) in enumerate(tree(r, 60)) if r.random() < 0.3] + [("a", 9, 3, 99), (None, 0, 50, 98)]
    points = [(f, p, "x") for f in ("a", "b", "c", None) for p in range(-1, 62)] + [("a", None, "x"), ("a", 5, "x"), ("a", 5, "x")]
    got = intervals.innermost(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), own=own, outer=True)

    def holds(f, p):
        if f is None or p is None:
            return None
        inside = [(b - a, i) for g, a, b, i in spans if g == f and (a <= p if own else a < p) and p <= b]
        return min(inside)[1] if inside else None

    assert sorted(((r["file"], r["pre"], r["id"]) for r in got.collect()), key=repr) == sorted(((f, p, holds(f, p)) for f, p, _ in points), key=repr)
    assert got.columns == ["file", "pre", "depth", "low", "high", "id"]
    inner = intervals.innermost(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), own=own)
    assert inner.count() == sum(holds(f, p) is not None for f, p, _ in points)
    none = intervals.outside(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), own=own)
    assert sorted(((r["file"], r["pre"]) for r in none.collect()), key=repr) == sorted(((f, p) for f, p, _ in points if holds(f, p) is None), key=repr)
    assert intervals.outside(spark.createDataFrame(points, POINTS), spark.createDataFrame([], SPANS)).count() == len(points)


def nodes(spark, source, path="m.py"):
    return python_code.parse(spark.createDataFrame([(path, source.encode())], "path string, content binary"))


def test_statement_lines_and_own_code(spark):
    source = "def f(a):\n    x = [\n        a,\n        1 if a else 2,\n    ]\n    def g():\n        return 1 if a else 2\n    return x\ny = 3\n"
    n = nodes(spark, source).cache()
    lines = {(r["text"], r["start_line"]): r["statement_line"] for r in syntax.statement_lines(n).where("kind IN ('identifier', 'literal')").collect()}
    assert lines[("a", 3)] == 2 and lines[("1", 4)] == 2 and lines[("1", 7)] == 7 and lines[("3", 9)] == 9
    spans = n.where("kind = 'function_definition'").selectExpr("file", "text AS unit", "pre", "post")
    own = {(r["unit"], r["start_line"]) for r in syntax.own_nodes(n, spans).where("kind = 'conditional_expression'").collect()}
    assert own == {("f", 4), ("g", 7)}
    assert {r["unit"]: r["complexity"] for r in syntax.own_complexity(n, spans).collect()} == {"f": 2, "g": 2}
    assert syntax.own_nodes(n, spans).where("start_line = 9").count() == 0


def test_statement_lines_are_linear(spark):
    def seconds(k):
        n = nodes(spark, "def f():\n" + "    x = [1, 2, 3, 4]\n" * k).cache()
        n.count()
        began = time.time()
        assert syntax.statement_lines(n).where("statement_line <> start_line").count() == 0
        return time.time() - began

    seconds(100)
    assert seconds(16_000) < 4 * seconds(8_000) + 2


@pytest.mark.parametrize("term", ['"a" + ', "a or ", "1 + ", "a and "])
def test_long_chains(spark, term):
    files = spark.createDataFrame([(f"{k}.py", ("x = " + term * k + '"a"\n').encode()) for k in (1, 1_500, 100_000)] + [("ok.py", b"def f():\n    return 1\n")], "path string, content binary")
    got = python_code.parse(files).cache()
    kinds = {r["file"]: r["n"] for r in got.where("kind IN ('binary_operator', 'boolean_operator')").groupBy("file").count().withColumnRenamed("count", "n").collect()}
    broken = {r["file"] for r in got.where("kind = 'error'").collect()}
    assert kinds["1.py"] == 1 and kinds["1500.py"] == 1_500 and (kinds.get("100000.py") == 100_000) != ("100000.py" in broken)
    assert got.where("file = 'ok.py' AND kind = 'function_definition'").count() == 1 and broken <= {"100000.py"}
    assert got.where("post IS NULL OR post < pre").count() == 0
    if term == '"a" + ':
        assert [len(r["value"]) for r in got.where("file = '1500.py' AND kind = 'binary_operator' AND value IS NOT NULL").collect()] == [1_501]


def test_long_call_chains(spark):
    got = nodes(spark, "client" + '.with_header("a", 1)' * 900 + '.get("/api/x")\nassert_that(a).b().c()\n').where("kind = 'call'").collect()
    assert len(got) == 904 and all(r["text"] for r in got)
    assert got[0]["text"] == "().get" and {r["text"] for r in got[901:]} == {"assert_that(a).b().c", "assert_that(a).b", "assert_that"}
