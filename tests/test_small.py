"""Small operators on hand-made rows: each rule, the rows that fit none, and no row twice."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loupe import sinks
from loupe.functions import scores
from loupe.operators import mutation, selection
from loupe.sources import project, python_code, snapshots


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


def test_carry_over_and_admission(spark):
    units = spark.createDataFrame([("h1", "n1"), ("h1", "n1"), ("h2", "n2"), ("h2", "n3"), (None, "n4")], "prev_hash string, hash string")
    exceptions = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "other"), (4, None)], "id int, hash string")
    assert rows(mutation.carry_over(exceptions, units)) == sorted([(1, "n1"), (2, "h2"), (3, "other"), (4, None)], key=repr)
    sites = spark.createDataFrame([("a", 1, 1, 2, "killed", False), ("a", 1, 1, 1, "survived", False), ("a", 2, 1, 3, "survived", True), ("a", 3, 1, 4, "killed", False), ("a", 4, 1, 5, None, False)], "file string, line int, column int, site int, outcome string, stale boolean")
    named = spark.createDataFrame([("a", n, 1) for n in (1, 2, 3, 4, 9)], "file string, line int, column int")
    assert rows(mutation.admit_named(named, sites), "line", "admission") == [(1, "admitted"), (2, "stale"), (3, "not a survivor: killed"), (4, "not a survivor: not judged"), (9, "no such site")]


def test_runs(spark):
    functions = lambda *r: spark.createDataFrame(list(r), "state string, flaky boolean, open_survivors int")
    assert rows(mutation.needs_coverage(functions(("fresh", False, 0)))) == [(False,)] and rows(mutation.needs_coverage(functions(("fresh", False, 0)).limit(0))) == [(False,)]
    for other in (("stale", False, 0), ("fresh", True, 0), ("fresh", False, 1)):
        assert rows(mutation.needs_coverage(functions(("fresh", False, 0), other))) == [(True,)]
    left = mutation.prune(spark.createDataFrame([(1, None), (2, "gone"), (3, "killed"), (4, "excluded"), (5, "changed"), (6, "moved")], "id int, why string"))
    assert rows(left, "id") == [(1,), (5,), (6,)]
    sites = spark.createDataFrame([(1, "killed", True, False), (2, None, True, False), (3, None, False, True), (4, None, False, False)], "id int, outcome string, begun boolean, after_stop boolean")
    assert rows(mutation.site_states(sites), "id", "state") == [(1, "completed"), (2, "cancelled"), (3, "blocked"), (4, "unattempted")]
    trials = [("a", "killed", 1, "killed"), ("b", "killed", 1, "survived"), ("b", "killed", 2, "killed"), ("c", "killed", 1, "survived"), ("d", "survived", 1, "survived")]
    assert rows(mutation.sample_agreement(spark.createDataFrame(trials, "id string, recorded string, ord int, outcome string"))) == [("agreed", 2), ("flaky", 1), ("pending", 1)]


def test_paths_and_maps(spark, tmp_path):
    files = spark.createDataFrame([("a/b/c.go", "go"), ("a/d.go", "go"), ("x/y.py", "python"), ("a/b/e.py", "python")], "file string, language string")
    assert rows(selection.build_roots(files, spark.createDataFrame([("a/b", "go"), ("x", "go"), ("a", "python"), ("a/b", "python")], "dir string, language string"))) == [("a/b/c.go", "go"), ("a/b/e.py", "python")]
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 2, "a": 1}), ({"a": 1}, {"a": 2}), ({}, {}), ({"a": 1}, {}), (None, {})], "a map<string,int>, b map<string,int>").select(snapshots.same_map(F.col("a"), F.col("b")).alias("same"))
    assert [r["same"] for r in maps.collect()] == [True, False, True, False, None]
    for name in ("a.py", "sub/b.py", ".hidden/c.py", "node_modules/d.py", "sub/__pycache__/e.py", "f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    found = python_code.discover(spark, [str(tmp_path), str(tmp_path / "sub")])
    assert sorted(r["path"].removeprefix(f"file:{tmp_path}/") for r in found.collect()) == ["a.py", "sub/b.py"]
    assert {r["hash"] for r in project.hashes(found).collect()} == {hashlib.sha256(b"x = 1\n").hexdigest()}


@pytest.mark.parametrize(("grade", "want"), [(1.0, 0.0), (10.0, 130.0), (5.5, 65.0), (0.0, 0.0), (12.0, 130.0), (None, None)])
def test_grade_hue(spark, grade, want):
    got = spark.createDataFrame([(grade,)], "g double").select(scores.grade_hue(F.col("g")).alias("h")).first()["h"]
    assert got == want


def test_tables(spark):
    pairs = spark.createDataFrame([(0.987, 3, 4)], "score double, a int, b int")
    assert rows(sinks.pair_table(pairs)) == [("0.99  3  4",)]
    reports = spark.createDataFrame([("b.py", 2.0, "stable"), ("a.py", 2.0, "stable"), ("c.py", 10.5, "split")], "file string, pressure double, action string")
    assert [r["line"].split()[-1] for r in sinks.report_table(reports).collect()] == ["c.py", "a.py", "b.py"]
