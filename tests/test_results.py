"""Evidence, exceptions and listed tests: every outcome occurs, and awkward rows have the results that are stated."""

import pytest
from pyspark.sql import functions as F

from loupe.operators import evidence, exceptions, listed
from loupe.plans import catalogue

SF = "/root/testdata/sf0.01"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("name", "column", "want"), [
    ("q_exception_locate", "why", {"held", "changed", "gone"}), ("q_exception_repointed", "how", {"holds", "named", "place", "only", "ambiguous", "none"}), ("q_listed_change", "changed", {True, False}),
    ("q_rests_on_importers", "rests_on_importers", {True, False}), ("q_line_evidence", "complete", {True, False}), ("q_block_evidence", "complete", {True, False}),
])
def test_every_outcome(spark, name, column, want):
    assert {r[0] for r in catalogue.QUERIES[name](spark, SF).select(column).distinct().collect()} == want


def test_every_refusal(spark):
    said = {r[0] for r in catalogue.QUERIES["q_exception_survivor"](spark, SF).selectExpr("regexp_replace(reason, 'fn[0-9]+', 'f')").distinct().collect()}
    assert said == {
        None, "it is no source file that is mutated", "there is no such file", "there is no mutation site there", "f has no mutation results", "f changed since its mutation results, or the tests that import its file did", "the results of f record no mutant there",
        "its mutant is recorded flaky, which its tests must settle, and only a survivor is excepted", "its mutant is recorded uncovered", "its mutant is recorded killed, and only a survivor is excepted",
    }


UNITS = "file string, unit int, function string, start_line int, hash string, prev_hash string"
SITES = "file string, unit int, site int, line int, column int, original string, replacement string, text string"
ENTRIES = "id int, file string, function string, hash string, line_in_function int, column int, original string, replacement string, line_text string, reason string"


def test_exceptions_by_hand(spark):
    units = spark.createDataFrame([("a", 0, "f", 10, "h", "old"), ("a", 1, "f", 30, "h", "old"), ("a", 2, "g", 50, "new", "was")], UNITS)
    sites = spark.createDataFrame([("a", 0, 0, 12, 4, "<", "<=", "a < b"), ("a", 1, 1, 32, 4, "<", "<=", "a < b"), ("a", 2, 2, 51, 1, "+", "-", "x + y"), ("a", 2, 3, 52, 1, "+", "-", "x + z")], SITES)
    entries = spark.createDataFrame([
        (1, "a", "f", "h", 3, 4, "<", "<=", "a<b", "r1"), (2, "a", "f", "h", 3, 4, "<", "<=", "a<b", "r2"), (3, "a", "f", "old", 3, 4, "<", "<=", None, None), (4, "a", "g", "was", 2, 1, "+", "-", "x+z", None), (5, "a", "gone", "h", 1, 1, "+", "-", None, None),
        (6, "b", "f", "h", 3, 4, "<", "<=", None, None), (7, "a", "f", "h", 3, 5, "<", "<=", None, None), (8, "a", "f", None, None, None, "<", "<=", None, None),
    ], ENTRIES)
    located = exceptions.locate(entries, units, sites)
    assert rows(located, "id", "why", "unit", "site", "line", "new_hash", "new_line") == [
        (1, "held", 0, 0, 12, None, None), (2, "held", 0, 0, 12, None, None), (3, "changed", None, None, 12, "h", 12), (4, "changed", None, None, 51, "new", 51), (5, "gone", None, None, 0, None, None),
        (6, "gone", None, None, 0, None, None), (7, "changed", None, None, 12, None, None), (8, "changed", None, None, 0, None, None),
    ]
    assert rows(exceptions.held_reasons(located)) == [("a", 0, 0, "r2", 2)]  # the site is one row, held twice
    survivors = spark.createDataFrame([(1, "a", "f", 3, 4, "<", "<="), (2, "a", "g", 3, 1, "+", "-"), (3, "a", "g", 2, 1, "+", "-"), (4, "a", "f", 9, 9, "<", "<="), (5, "c", "f", 1, 1, "+", "-")], "survivor int, file string, function string, line_in_function int, column int, original string, replacement string")
    # 1: an entry holds there; 2: the text of entry 4 names that place; 3: entry 4 is at its place; 4: of three stale entries none names it; 5: nothing of that change
    assert rows(exceptions.repointed(survivors, entries, units, sites), "survivor", "exception", "how") == [(1, None, "holds"), (2, 4, "named"), (3, 4, "place"), (4, None, "ambiguous"), (5, None, "none")]
    assert exceptions.locate(entries.limit(0), units, sites).count() == 0 and rows(exceptions.locate(entries.where("id = 1"), units.limit(0), sites), "why") == [("gone",)]


def test_evidence_by_hand(spark):
    units = spark.createDataFrame([("a", "outer", "typescript", 1, 2, 20), ("a", "inner", "typescript", 5, 6, 8), ("a", "oneline", "typescript", 10, 10, 10), ("a", "same", "typescript", 12, 12, 14), ("a", "bodyless", "kotlin", 30, None, 30), ("b", "f", "go", 1, 0, 3)], "file string, unit string, language string, start_line int, body_line int, end_line int")
    lines = spark.createDataFrame([(f, n, n % 2 == 0) for f in "ab" for n in range(1, 31)], "file string, line int, covered boolean")
    got = {r["unit"]: ([b["line"] for b in r["blocks"]], r["complete"]) for r in evidence.line_evidence(units, lines, spark.createDataFrame([("a", True), ("b", False)], "file string, proven boolean")).collect()}
    assert got == {
        "outer": ([2, 3, 4, 5, 9, 10, 11, 12, 15, 16, 17, 18, 19, 20], True), "inner": ([6, 7, 8], True), "oneline": ([10], True), "same": ([12, 13, 14], True), "bodyless": ([], True), "f": ([], False),
    }


def test_listed_tests_by_hand(spark):
    tests = spark.createDataFrame([(1, "t1", "f1", None), (1, "t2", "", "p"), (1, "t3", None, ""), (1, "t4", "f4", ""), (2, "t1", "f1", "p")], "snapshot int, test string, file string, fingerprint string")
    files = spark.createDataFrame([(1, "f1", "h1"), (1, "f4", ""), (2, "f1", "h1")], "snapshot int, file string, hash string")
    mutants = spark.createDataFrame([(1, 1, "a", "listed", "killed", ["t1", "t2"]), (1, 1, "b", "listed", "survived", ["t1"]), (1, 2, "c", "listed", "timeout", ["t1", "t3"]), (1, 2, "d", "listed", "killed", ["t4"]), (1, 3, "e", "suite", "killed", ["t1"]), (1, 4, "f", "listed", "killed", []), (1, 4, "g", "listed", "killed", None), (2, 1, "a", "listed", "over-limit", ["t1"]), (3, 1, "a", "listed", "killed", ["t1"])], "snapshot int, unit int, key string, scope string, outcome string, tests array<string>")
    snapshots = spark.createDataFrame([(1, True), (2, True), (3, False)], "snapshot int, records_tests boolean")
    marked = listed.rests_on_importers(mutants, tests, files, snapshots)
    assert rows(marked.where("NOT rests_on_importers"), "snapshot", "key") == [(1, "a"), (2, "a")]
    assert rows(listed.changed_tests(tests, files, spark.createDataFrame([("f1", "new"), ("f4", None)], "file string, hash string"))) == sorted([(1, "t1", "f1"), (1, "t2", None), (2, "t1", None)], key=repr)
    listing = spark.createDataFrame([("t1", "p"), ("t2", "q")], "test string, fingerprint string")
    changes = listed.changed_tests(tests, files, spark.createDataFrame([("f1", "new")], "file string, hash string"), listing)
    assert rows(changes) == sorted([(1, "t1", "f1"), (1, "t2", None)], key=repr)
    got = listed.listed_change(mutants, changes, spark.createDataFrame([(3, "conftest.py")], "snapshot int, file string"))
    assert rows(got) == sorted([(1, 1, ["f1"], ["t2"], True), (1, 2, ["f1"], [], True), (1, 4, [], [], False), (2, 1, [], [], False), (3, 1, ["conftest.py"], [], True)], key=repr)


def test_merged_reports(spark):
    """The same reports in another order differ in tests, in unloaded files and in the order of lists, and in nothing else."""
    from loupe.operators import reports

    def merged(numbers):
        make = lambda rows, schema: spark.createDataFrame([(numbers[r[0]], *r[1:]) for r in rows], schema)
        one = reports.merge(reports.Reports(
            make([("a", 0, "files", "x", "a0"), ("a", 1, "files", "x", "a1"), ("b", 0, "files", "x", "b0"), ("b", 0, "branches", "x", "bb")], "report int, ord int, part string, file string, value string"),
            make([("b", 0, "missing", "m1"), ("a", 0, "missing", "m2")], "report int, ord int, list string, value string"), make([("a", "go"), ("b", "go"), ("b", "dart")], "report int, language string"),
            make([("a", "t1"), ("b", "t2")], "report int, test string"), make([("a",), ("b",)], "report int"), make([("a", "x"), ("b", "x")], "report int, file string"), make([("a", "u", "w1"), ("b", "u", "w2")], "report int, file string, why string"),
        ))
        return {n: rows(getattr(one, n).drop("report")) for n in ("segments", "notes", "languages", "tests", "proven", "unloaded")} | {"x": [r["value"] for r in one.segments.where("part = 'files'").orderBy("ord").collect()]}

    there, back = merged({"a": 1, "b": 2}), merged({"a": 2, "b": 1})
    assert there["x"] == ["a0", "a1", "b0"] and back["x"] == ["b0", "a0", "a1"]
    assert (there["tests"], back["tests"]) == ([("t1",)], [("t2",)]) and (there["unloaded"], back["unloaded"]) == ([("u", "w2")], [("u", "w1")])
    assert all(there[n] == back[n] for n in ("languages", "proven")) and there["languages"] == [("dart",), ("go",)] and there["proven"] == [("x",)]


def most_rows(df):
    """The largest number of rows that a step of the query made."""
    df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        made, children = plan.metrics().get("numOutputRows"), plan.children()
        return max([made.get().value() if made.isDefined() else 0, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_no_exception_meets_each_site_or_survivor(spark):
    n = 400
    units = spark.createDataFrame([("f", 1, "x", 10, "h", "g")], "file string, unit int, function string, start_line int, hash string, prev_hash string")
    ids = spark.range(n).selectExpr("cast(id AS int) AS i")
    sites = ids.selectExpr("'f' AS file", "1 AS unit", "i AS site", "10 + i % 20 AS line", "i % 3 AS column", "'a' AS original", "'b' AS replacement", "concat('t ', i % 7) AS text")
    entries = ids.selectExpr("i AS id", "'f' AS file", "'x' AS function", "if(i % 2 = 0, 'h', 'o') AS hash", "i % 25 + 1 AS line_in_function", "i % 4 AS column", "'a' AS original", "'b' AS replacement", "if(i % 3 = 0, NULL, concat('t', i % 9)) AS line_text")
    survivors = ids.selectExpr("i AS survivor", "'f' AS file", "'x' AS function", "i % 25 + 1 AS line_in_function", "i % 5 AS column", "'a' AS original", "'b' AS replacement")
    assert most_rows(exceptions.locate(entries, units, sites)) <= 2 * n
    assert most_rows(exceptions.held_reasons(exceptions.locate(entries, units, sites).withColumn("reason", F.col("hash")))) <= 2 * n
    assert most_rows(exceptions.repointed(survivors, entries, units, sites)) <= 2 * n


def test_line_evidence_is_summed_as_rows(spark):
    units = spark.createDataFrame([("f", "a", "go", 1, 2, 30), ("f", "b", "go", 5, 5, 9), ("f", "k", "kotlin", 12, None, 14), ("g", "c", "go", 1, 2, 9)], "file string, unit string, language string, start_line int, body_line int, end_line int")
    lines = spark.range(1, 41).selectExpr("if(id % 10 = 0, 'g', 'f') AS file", "cast(id AS int) AS line", "id % 3 = 0 AS covered")
    files = spark.createDataFrame([("f", True), ("g", False)], "file string, proven boolean")
    want = {r["unit"]: (r["complete"], len(r["blocks"]), sum(b["covered"] for b in r["blocks"]), sum(b["line"] for b in r["blocks"])) for r in evidence.line_evidence(units, lines, files).collect()}
    assert {r["unit"]: (r["complete"], r["n_blocks"], r["n_covered"], r["places"]) for r in evidence.line_sums(units, lines, files).collect()} == want
    assert "collect_list" not in catalogue.QUERIES["q_line_evidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
