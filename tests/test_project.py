"""Imports, recorded results, project files and text forms on hand-made rows."""

import subprocess

from pyspark.sql import functions as F

from loupe import sinks
from loupe.operators import imports, mutation
from loupe.sources import project


def rows(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)


def test_python_imports(spark):
    files = spark.createDataFrame([("pkg/__init__.py", "pkg", "pkg", True, False), ("pkg/a.py", "pkg/a", "pkg.a", False, False), ("pkg/sub/b.py", "pkg/sub/b", "pkg.sub.b", False, False), ("tests/t.py", "tests/t", "tests.t", False, True), ("tests/h.py", "tests/h", "tests.h", False, True)], "file string, module string, namespace string, is_package boolean, is_test boolean")
    wanted = spark.createDataFrame([("pkg/sub/b.py", "..a", None), ("pkg/sub/b.py", "..", "a"), ("pkg/a.py", "os.path", None), ("tests/t.py", "h", None), ("pkg/a.py", "pkg.sub.b.deep", "x"), ("pkg/a.py", "....x", None), ("pkg/a.py", ".", "zzz")], "file string, target string, name string")
    assert rows(imports.resolve_python(wanted, files), "target", "name", "module", "external") == sorted([("..a", None, "pkg/a", None), ("..", "a", "pkg/a", None), ("os.path", None, None, "os"), ("h", None, "tests/h", None), ("pkg.sub.b.deep", "x", "pkg/sub/b", None), (".", "zzz", "pkg", None)], key=repr)


def test_typescript_kotlin_and_dart_imports(spark):
    files = spark.createDataFrame([("src/a.ts", "src/a"), ("src/ui/index.tsx", "src/ui"), ("lib/x.ts", "lib/x")], "file string, module string")
    aliases = spark.createDataFrame([("@lib/", "lib/", 0), ("", "src/", 0)], "prefix string, alias string, rank int")
    wanted = spark.createDataFrame([("src/a.ts", "./ui"), ("src/ui/index.tsx", "../a.js"), ("src/a.ts", "@lib/x"), ("src/a.ts", "ui"), ("src/a.ts", "@scope/pkg/deep"), ("src/a.ts", "react")], "file string, target string")
    got = {r["target"]: (r["module"], r["external"]) for r in imports.resolve_paths(wanted, files, aliases).collect()}
    assert got == {"./ui": ("src/ui", None), "../a.js": ("src/a", None), "@lib/x": ("lib/x", None), "ui": ("src/ui", None), "@scope/pkg/deep": (None, "@scope/pkg"), "react": (None, "react")}
    names = spark.createDataFrame([("p.q.Box", "m1", "p.q"), ("p.q.make", "m2", "p.q")], "name string, module string, package string")
    wanted = spark.createDataFrame([("f", "p.q.*"), ("f", "p.q.Box.inner"), ("f", "java.util.List")], "file string, target string")
    assert rows(imports.resolve_kotlin(wanted, names), "target", "module", "external") == sorted([("p.q.*", "m1", None), ("p.q.*", "m2", None), ("p.q.Box.inner", "m1", None), ("java.util.List", None, "java")], key=repr)
    dart = spark.createDataFrame([("lib/a.dart", "m/a", "app"), ("lib/b/c.dart", "m/c", "app")], "file string, module string, package string")
    wanted = spark.createDataFrame([("lib/a.dart", "package:app/b/c.dart"), ("lib/a.dart", "b/c.dart"), ("lib/b/c.dart", "../a.dart"), ("lib/a.dart", "dart:io"), ("lib/a.dart", "package:http/http.dart")], "file string, target string")
    assert rows(imports.resolve_dart(wanted, dart), "module", "external") == sorted([("m/c", None), ("m/c", None), ("m/a", None), (None, "dart:io"), (None, "package:http")], key=repr)


def test_reaching_tests_and_groups(spark):
    edges = spark.createDataFrame([("t1", "a"), ("a", "b"), ("conf", "c")], "src string, dst string")
    tests = spark.createDataFrame([("tests/t1.py", "t1")], "test string, module string")
    support = spark.createDataFrame([("tests", "conf")], "dir string, module string")
    assert rows(imports.tests_reaching(tests, edges, support), "module") == [("a",), ("b",), ("c",), ("conf",), ("t1",)]
    assert rows(imports.tests_reaching(tests, edges, one_hop=True), "module") == [("a",), ("t1",)]
    sources = spark.createDataFrame([("a", "python", "r"), ("b", "python", "r"), ("z", "python", "r")], "source string, language string, root string")
    reaching = spark.createDataFrame([("a", "t"), ("b", "t")], "source string, test string")
    assert rows(imports.plan_groups(sources, reaching), "sources", "unreached") == [(["a", "b"], False), (["z"], True)]


def test_recorded_results(spark):
    units = spark.createDataFrame([(1, "f", 1, "h1"), (2, "g", 1, "new")], "unit int, id string, ord int, hash string")
    recorded = spark.createDataFrame([(10, "f", 1, "h1", False), (11, "g", 1, "old", False)], "entry int, id string, ord int, hash string, stale boolean")
    mutants = spark.createDataFrame([(10, "k1", "killed"), (10, "k2", "survived"), (11, "k3", "killed")], "entry int, key string, outcome string")
    kept = mutation.remembered(units, recorded, mutants)
    assert rows(kept, "unit", "key") == [(1, "k1"), (1, "k2")]
    sites = spark.createDataFrame([(1, "k1", True, False), (1, "k2", True, False), (1, "k2x", True, True), (2, "k3", True, False), (2, "k4", False, False)], "unit int, key string, judged boolean, excepted boolean")
    facts = kept.withColumns({c: F.lit(False) for c in ("flaky", "rests_on_change", "broad_stale")})
    assert rows(mutation.run_plan(sites, facts), "key", "state") == [("k1", "reused"), ("k2", "pending"), ("k2x", "pending"), ("k3", "pending"), ("k4", "skipped")]
    assert rows(mutation.run_plan(sites, facts, all_sites=True).where("key = 'k1'"), "state") == [("pending",)]
    now = spark.createDataFrame([("f", 1, "h1", False), ("g", 1, "new", False), ("j", 1, "hj", True), ("n", 1, "hn", False)], "id string, ord int, hash string, judged boolean")
    was = spark.createDataFrame([("f", 1, "h1", False, True), ("g", 1, "old", False, False)], "id string, ord int, hash string, stale boolean, rests_on_importers boolean")
    assert rows(mutation.keep_unjudged(now, was, tests_hold=False), "id", "hash", "stale") == [("f", "h1", True), ("g", "old", False), ("j", "hj", False)]
    assert rows(mutation.proof(spark.createDataFrame([("uncovered",)], "outcome string"))) == [(None, None, None, None)]
    assert rows(mutation.proof(mutants)) == [(2, 1, 0, 3)]


def test_evidence_and_exceptions(spark):
    functions = spark.createDataFrame([("f", "a", "h", True), ("f", "b", "h", True), ("f", "c", "h", True), ("f", "d", "h", False)], "file string, function string, hash string, supported boolean")
    evidence = spark.createDataFrame([("f", "a", "h", True, ["x", "@producer"]), ("f", "b", "h", True, ["y"]), ("f", "c", "old", True, [])], "file string, function string, hash string, complete boolean, inputs array<string>")
    changed = mutation.changed_files(spark.createDataFrame([("x", "1"), ("y", "1"), ("@producer", "1")], "file string, hash string"), spark.createDataFrame([("x", "1"), ("y", "2"), ("@producer", "2")], "file string, hash string"))
    assert rows(mutation.coverage_evidence(functions, evidence, changed), "function", "state") == [("a", "fresh"), ("b", "stale"), ("c", "missing"), ("d", "unsupported")]
    mutants = spark.createDataFrame([("u", "all", ["y", "x"]), ("v", "all", None), ("w", "own", None)], "unit string, scope string, evidence array<string>")
    assert rows(mutation.broad_changes(mutants, changed)) == [("u", ["y"]), ("v", ["whole-suite evidence"])]
    held = spark.createDataFrame([(1, "survived"), (2, "timeout"), (3, "uncovered")], "id int, outcome string")
    assert rows(mutation.judge_exceptions(held), "id", "bearing") == [(1, "excepted"), (2, "stale"), (3, "none")]
    moved = mutation.moved_elsewhere(spark.createDataFrame([(1, "f", "n", "h"), (2, "f", "m", "h")], "id int, file string, name string, hash string"), spark.createDataFrame([("g", "n", "h"), ("g", "m", "h"), ("k", "m", "h")], "file string, name string, hash string"))
    assert rows(moved, "id", "moved_to") == [(1, "g"), (2, None)]
    identity = spark.range(1).select(*(c.alias(n) for n, c in mutation.parse_identity(F.lit("a/b.go:12:3 pkg.F == -> !=")).items()))
    assert rows(identity) == [("a/b.go", 12, 3, "pkg.F", "==", "!=")]
    stop = spark.createDataFrame([("uncovered", "b", 9), ("uncovered", "a", 7), ("coverage", "a", 1)], "kind string, file string, line int")
    assert rows(mutation.first_stop(stop)) == [("uncovered", "a", 7)]
    source = spark.createDataFrame([(bytearray("é == 1".encode()), 3)], "s binary, at int")
    assert bytes(source.select(mutation.apply_site(F.col("s"), F.col("at"), F.lit("=="), F.lit("!=")).alias("x")).first()["x"]) == "é != 1".encode()


def test_project_files(spark, tmp_path):
    files = spark.createDataFrame([("build/a.py",), ("x/package.json",), ("x/dist/b.js",), ("x/src/c.js",), ("y/out/d.py",)], "path string")
    assert rows(project.without_build_outputs(files)) == [("build/a.py",), ("x/package.json",), ("x/src/c.js",), ("y/out/d.py",)]
    assert ("y/out/d.py",) not in rows(project.without_build_outputs(files, spark.createDataFrame([("y/out",)], "dir string")))
    dart = spark.createDataFrame([("a.g.dart", b"x"), ("b.dart", b"// GENERATED CODE - DO NOT MODIFY BY HAND"), ("c.dart", b"main() {}")], "path string, content binary")
    assert rows(project.without_generated_dart(dart), "path") == [("c.dart",)]
    (tmp_path / "tsconfig.json").write_text('{ // base\n "extends": "./up", "files": [],\n}')
    (tmp_path / "up.json").write_text('{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], /* x */ "one": ["lib/one.ts"],}}}')
    assert rows(project.tsconfig_aliases(spark, str(tmp_path))) == [("", "", 0), ("@/", "src/", 0), ("one", "lib/one.ts", 0)]
    logs = spark.createDataFrame([(1, "ok  \tm/a\t1s\npanic: test timed out after 1s\n\nFAIL\tm/b\t1s\nFAIL\tm/c\t1s")], "report int, text string")
    assert rows(project.timed_out_packages(logs)) == [("m/b",)]
    names = spark.createDataFrame([("git@h:o/repo.git", "d"), (None, "d"), ("https://h/o/two/", "d")], "url string, folder string")
    assert rows(names.select(project.repository_name(F.col("url"), F.col("folder")).alias("n"))) == [("d",), ("repo",), ("two",)]


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for name in ("a.py", "b.py", "c.py"):
        (tmp_path / name).write_text("".join(f"{name} line {i}\n" for i in range(20)))
    run("add", "-A")
    run("commit", "-qm", "one")
    run("checkout", "-qb", "work")
    (tmp_path / "a.py").write_text((tmp_path / "a.py").read_text().replace("line 5", "changed"))
    run("mv", "b.py", "d.py")
    run("rm", "-q", "c.py")
    run("add", "-A")
    run("commit", "-qm", "two")
    (tmp_path / "new.py").write_text("x")
    from loupe.sources import reports

    assert rows(project.changed_files(spark, str(tmp_path))) == [("new.py",)]
    assert rows(reports.read_diff(project.diff_since(spark, str(tmp_path), "main"))) == [("a.py", 6, 6, False)]
    assert rows(project.removed_since(spark, str(tmp_path), "main")) == [("b.py", "d.py"), ("c.py", None)]


def test_text_forms(spark):
    scored = spark.createDataFrame([("f", 3, 0.5, 4.1), ("g", 2, None, None)], "name string, complexity int, coverage double, crap double")
    assert [r["line"].split() for r in sinks.crap_table(scored).collect()] == [["4.1", "3", "50%", "f"], ["N/A", "2", "N/A", "g"]]
    m = spark.createDataFrame([("f", 2, "a", "b", "survived"), ("f", 1, "c", "d", "killed")], "file string, line int, original string, replacement string, outcome string")
    assert rows(sinks.annotation(m)) == [("f", "killed 1, survived 1, uncovered 0\n2: a -> b")]
    items = spark.createDataFrame([(["a", "b", "c", "d", "e"],), (["a"],)], "x array<string>")
    assert [r[0] for r in items.select(sinks.first_three(F.col("x"))).collect()] == ["a, b, c and 2 more", "a"]
    assert [r[0] for r in items.select(sinks.test_command("run {ids} -k {pattern} {id}", F.col("x"))).collect()][1] == "run a -k a a"
    tags, messages = spark.createDataFrame([("v1.9.0",), ("v1.10.2",), ("x",)], "tag string"), spark.createDataFrame([("fix: a",), ("feat(x): b",)], "message string")
    assert rows(sinks.next_version(tags, messages)) == [("1.11.0",)]
    assert rows(sinks.unique_names(spark.createDataFrame([("r", 1), ("r", 2)], "name string, at int"), "name", "at"), "name") == [("r",), ("r-2",)]
