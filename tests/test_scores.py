"""Golden values of scores, grades and paths."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loupe.functions import paths, scores
from loupe.operators import crap


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("complexity", "percent", "expected"), [(1, 0, 2.0), (5, 100, 5.0), (5, 0, 30.0), (10, 50, 22.5), (10, 0, 110.0)])
def test_crap(spark, complexity, percent, expected):
    assert value(spark, scores.crap(F.lit(complexity), F.lit(percent / 100))) == expected


def test_crap_order_and_bands(spark):
    units = spark.createDataFrame([(1, 3, None), (2, 1, 0.0), (3, 10, 0.5), (4, 9, None), (5, 1, 0.0)], "ord int, complexity int, coverage double")
    scored = crap.score(units)
    assert [r["ord"] for r in crap.worst(scored).collect()] == [3, 2, 5, 4, 1]
    assert [r["ord"] for r in crap.worst(scored, 2).collect()] == [3, 2]
    assert {r["ord"]: r["band"] for r in scored.collect()} == {1: "unknown", 2: "low", 3: "medium", 4: "unknown", 5: "low"}
    assert [r["ord"] for r in crap.problems(scored, 22.5).collect()] == []
    assert [value(spark, scores.band(F.lit(x))) for x in (5, 17, 30)] == ["low", "medium", "high"]


def test_unloaded_file_of_a_measured_language_is_untested(spark):
    units = spark.createDataFrame([(1, "a", 0.5), (2, "a", None), (3, "b", None)], "ord int, language string, coverage double")
    assert {r["ord"]: r["coverage"] for r in crap.unloaded_as_untested(units).collect()} == {1: 0.5, 2: 0.0, 3: None}


@pytest.mark.parametrize(("bands", "grade"), [((9, 0, 1), 8.2), ((1, 0, 1), 1.0), ((7, 3, 0), 8.4), ((0, 0, 0), None)])
def test_band_grade(spark, bands, grade):
    got = value(spark, scores.band_grade(*(F.lit(b) for b in bands)))
    assert got == grade


def test_other_grades(spark):
    assert [value(spark, scores.crap_grade(F.lit(x))) for x in (3.0, 30.0, 17.5)] == [10.0, 1.0, 5.5]
    assert value(spark, scores.mutation_grade(F.lit(9), F.lit(1))) == 9.1
    assert value(spark, scores.mutation_grade(F.lit(0), F.lit(4))) == 1.0
    assert value(spark, scores.mutation_grade(F.lit(0), F.lit(0))) is None
    assert value(spark, scores.overall_grade(F.lit(8.0), F.lit(None).cast("double"))) == 8.0


@pytest.mark.parametrize(("of", "expected"), [((8, 0, 0, 2), 1.0), ((8, 0, 0, 0), 7.0), ((35, 2, 4, 1), 13.0)])
def test_example_score(spark, of, expected):
    assert value(spark, scores.example_score(*(F.lit(x) for x in of))) == expected


@pytest.mark.parametrize(
    ("raw", "route"),
    [("https://h.x/users/42?x=1", "/users/42"), ("/users/{id}/", "/users/*"), ("/a/:b/<c>/*d", "/a/*/*/*"), ("{}/api/x{}y", "/api/*"), ("users", None), ("/", "/"), ("/files/{$}", "/files")],
)
def test_normalise_route(spark, raw, route):
    assert value(spark, paths.normalise_route(F.lit(raw))) == route


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("**/*.go", ["a.go", "x/y/a.go"], ["a.py"]), ("src/**", ["src/a", "src/a/b", "src"], ["srca", "x/src/a"]), ("*.{ts,js}", ["a.ts", "b.js"], ["a.go", "d/a.ts"]), ("a?c[!x].py", ["abcd.py"], ["abcx.py", "a/cd.py"])],
)
def test_globs(spark, glob, yes, no):
    got = spark.createDataFrame([(p,) for p in yes + no], "path string").select("path", paths.matches_any(F.col("path"), [glob]).alias("hit")).collect()
    assert {r["path"] for r in got if r["hit"]} == set(yes)


def test_ancestors_and_tails(spark):
    assert value(spark, paths.ancestors(F.lit("a/b/c"))) == ["a/b/c", "a/b", "a", "(root)"]
    assert value(spark, paths.shared_tail(F.lit("x/b/c"), F.lit("a/b/c"))) == 2
    assert value(spark, paths.shared_tail(F.lit("b/c"), F.lit("a/b/c"))) == 2
    assert value(spark, paths.module_of(F.lit("src/pkg/__init__.py"))) == "pkg"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.floats(0, 1)), min_size=2, max_size=20))
def test_crap_is_monotone(spark, rows):
    got = spark.createDataFrame(rows, "c int, v double").select("c", "v", scores.crap(F.col("c"), F.col("v")).alias("s")).collect()
    for r in got:
        assert r["s"] >= r["c"] - 1e-9
        for q in got:
            if q["c"] >= r["c"] and q["v"] <= r["v"]:
                assert q["s"] >= r["s"] - 1e-6 or math.isclose(q["s"], r["s"])
