"""The command of a source's tests and the suite behind it."""

from loupe.operators import runs

REQUEST = "id int, language string, tool string, bin array<string>, root string, module string, path string, whole boolean, shell string"


def test_every_rule_is_reached_and_none_is_ambiguous(spark):
    tools = {None, *(r[1] for r in runs.RULES)}
    requests, tests, spreads = [], [], {"none": [], "one": ["r/m"], "many": ["r/m", "r/n"], "other": ["r/n"]}
    for language in ("go", "typescript", "python", "dart", "kotlin", "cobol"):
        for tool in tools | {"pnpm"}:
            for whole in (True, False):
                for folders in spreads.values():
                    i = len(requests)
                    requests.append((i, language, tool, ["b"], "r", "r/m", "r/m/f.x", whole, None))
                    tests += [(i, f, "A", "a") for f in folders]
    got = runs.choose(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(tests, "id int, folder string, name string, module string")).collect()
    assert len(got) == len(requests) and {r["rule"] for r in got} == {None, *range(len(runs.RULES))}
    assert all((r["rule"] is None) == (r["args"] is None) for r in got) and not any("{" in a for r in got for a in r["args"] or [])
    for i, a in enumerate(runs.RULES):  # two rules that fit one request differ in how specific they are
        for b in runs.RULES[:i]:
            if a[0] == b[0] and all(x is None or y is None or x == y for x, y in zip(a[1:4], b[1:4], strict=True)):
                assert sum(x is None for x in a) != sum(x is None for x in b)


def test_commands(spark):
    rows = [
        (1, "go", None, [], "r", "r", "r/a.go", False, None), (2, "typescript", "pnpm", ["pnpm"], "r", "r", "r/a.ts", False, ""), (3, "python", "pytest", ["py"], "r", "r", "r/a.py", False, "make"),
        (4, "dart", "flutter", ["fvm", "flutter"], "", "", "lib/a.dart", False, None), (5, "kotlin", "gradle", ["./gradlew"], "r", "r", "r/x/A.kt", False, None), (6, "kotlin", "mvn", ["mvn"], "r", "r/x", "r/x/A.kt", False, None),
        (7, "python", "pytest", ["py"], "r", "r", "r/a.py", False, None), (8, "dart", None, [], "r", "r", "r/a.dart", True, None), (9, "dart", "flutter", ["flutter"], "r", "r", "r/a.dart", True, "sh run"),
    ]
    tests = [(4, "test", "test/a_test.dart", None), (4, "test", "test/a_test.dart", None), (5, "r", "p.T", None), (5, "r/x/y", "q.B", None), (5, "r/x/y", "q.A", None), (5, "rx", "no.No", None), (6, "r/x", "q.X", None), (6, "r/y", "q.Y", None), (7, "elsewhere", "t.py", "t")]
    got = {r["id"]: r for r in runs.choose(spark.createDataFrame(rows, REQUEST), spark.createDataFrame(tests, "id int, folder string, name string, module string")).collect()}
    args = {i: None if r["args"] is None else " ".join(r["args"]) for i, r in got.items()}
    assert args == {
        1: "go test -count=1 -failfast ./.", 2: "pnpm run test", 3: None, 4: "fvm flutter test --no-pub test/a_test.dart", 5: "./gradlew :test --fail-fast --tests p.T :x:y:test --fail-fast --tests q.A --tests q.B",
        6: "mvn -q test -pl x,y -am -Dtest=q.X,q.Y -Dsurefire.failIfNoSpecifiedTests=false", 7: None, 8: None, 9: None,
    }
    assert {i for i, r in got.items() if r["suite"]} == {2} and got[4]["ready"] == ["fvm", "flutter", "pub", "get", "--offline"] and got[8]["ready"] is None and got[9]["ready"] is None
    assert got[6]["folder"] == "r" and got[3]["path_dirs"] == [".", "src"]


def test_dart_suites_and_eligible_tests(spark):
    markers = spark.createDataFrame([("pkg",), ("pkg/sub",)], "marker string")
    sources = spark.createDataFrame([("pkg/lib/a.dart", "dart", "r", "all"), ("pkg/sub/lib/b.dart", "dart", "r", "shell"), ("free/c.dart", "dart", "r", "all"), ("top.dart", "dart", "r", "all"), ("x.go", "go", "r", "all")], "path string, language string, root string, scope string")
    names = ["pkg/test/a_test.dart", "pkg/sub/test/b_test.dart", "free/test/c_test.dart", "test/t_test.dart", "pkg/integration_test/d_test.dart"]
    tests = spark.createDataFrame([("r", n, "h") for n in names], "root string, test string, hash string")
    got = {}
    for r in runs.suite(sources, tests, markers).collect():
        got.setdefault(r["path"], set()).add(r["test"])
    assert got == {"pkg/lib/a.dart": {names[0]}, "pkg/sub/lib/b.dart": set(names), "free/c.dart": {names[2]}, "top.dart": {names[3]}, "x.go": set(names)}
    reach = [("pkg/lib/a.dart", t) for t in (names[0], names[4], "pkg/test/help.dart", "pkg/integration_test/help.dart", "pkg/lib/support.dart")] + [("pkg/sub/lib/b.dart", t) for t in (names[4], "pkg/sub/test/help.dart")] + [("x.go", "x_test.go")]
    kept = runs.eligible(spark.createDataFrame(reach, "path string, test string"), sources, markers)
    assert sorted(tuple(r) for r in kept.collect()) == [("pkg/lib/a.dart", "pkg/lib/support.dart"), ("pkg/lib/a.dart", names[0]), ("pkg/lib/a.dart", "pkg/test/help.dart"), ("x.go", "x_test.go")]
