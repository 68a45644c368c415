"""Routes, examples and whole questions over small Python files."""

from pyspark.sql import functions as F

from loupe import commands
from loupe.operators import crap as crap_
from loupe.operators import endpoints, examples, syntax
from loupe.sources import python_code

API = '''
import requests
BASE = "http://x"

@app.get("/users/{id}")
def one(id):
    return client.get("not a path")

@app.route("/health")
def health():
    pass

@cached("/no")
def other():
    requests.post(f"{BASE}/orders/{n}/items", json={})
    requests.get("/" + kind)
    self.client.delete("/orders/" + str(n))
    rows.get("/orders")
'''

TESTS = '''
import pytest

def helper(x):
    assert x

def outer(x):
    helper(x)

def before(x):
    after(x)

def after(x):
    outer(x)

@pytest.fixture
def base():
    return 1

@pytest.mark.parametrize("a", [
    1,
    2,
])
def test_table(a):
    assert a and a > 0

class TestThing:
    def setUp(self):
        self.x = 1

    def test_guard(self):
        if self.x and check(1):
            self.assertTrue(self.x)
        if self.x:
            y = 2

    def test_loop(self):
        cases = [
            1,
            2,
        ]
        for c in cases:
            assert c
        for d in range(3):
            if d:
                print(d)

    class TestInner:
        def test_mocks(self, mocker):
            mocker.patch("a.b")
            with patch("c.d") as m:
                before(m)
            checkout(m)
            text = """
            a
            """

if True:
    def test_hidden():
        pass
'''

CODE = '''
class Box:
    def add(self, x):
        if x > 1:
            return 1
        elif x > 0 and x < 9:
            return 2
        return 3

    def put(self, y):
        if y > 1:
            return 1
        elif y > 0 and y < 9:
            return 2
        return 3

def lone():
    return 1
'''


def files(spark, **bodies):
    return spark.createDataFrame([(k.replace("__", "/") + ".py", bytearray(v.encode())) for k, v in bodies.items()], "path string, content binary")


def test_endpoints(spark):
    got = endpoints.endpoints(python_code.parse(files(spark, api=API)))
    assert sorted((r["side"], r["method"], r["path"], r["line"]) for r in got.collect()) == [
        ("calls", "DELETE", "/orders/*", 17), ("calls", "POST", "/orders/*/items", 15), ("serves", "", "/health", 9), ("serves", "GET", "/users/*", 5),
    ]


def test_routes_by_module(spark):
    body = 'import httpx\ndef f():\n    httpx.get(f"/users/{i}")\n'
    got = commands.routes(files(spark, api=API, src__ask=body))
    assert [(r["src"], r["dst"]) for r in got.collect()] == [("ask", "api")]


def test_examples(spark):
    nodes = python_code.parse(files(spark, test_a=TESTS))
    got = examples.measured(examples.examples(nodes), nodes)
    assert [tuple(r) for r in got.orderBy("ord").select("group", "name", "raw_lines", "lines", "decisions", "mocks", "assertions", "is_table").collect()] == [
        ("", "test_table", 6, 3, 0, 0, 1, True),
        ("TestThing", "test_guard", 5, 5, 1, 0, 1, False),
        ("TestThing", "test_loop", 10, 7, 2, 0, 1, True),
        ("TestThing › TestInner", "test_mocks", 8, 6, 0, 2, 1, False),
    ]
    assert [(r["file"], r["setup_lines"]) for r in examples.setup_lines(nodes).collect()] == [("test_a.py", 5)]


def test_helpers_are_found_in_two_rounds(spark):
    # three that run against the order: the third is a step too far
    body = "def a(x):\n    b(x)\ndef b(x):\n    c(x)\ndef c(x):\n    d(x)\ndef d(x):\n    assert x\n"
    found = examples.helpers(python_code.parse(files(spark, test_b=body)))
    assert sorted(r["called"] for r in found.collect()) == ["c", "d"]


def test_units_and_dry(spark):
    source = files(spark, src__box=CODE, test_box=TESTS)
    got = commands.units(source).where("file = 'src/box.py'").collect()
    assert [(r["namespace"], r["name"], r["kind"], r["complexity"]) for r in got] == [("Box", "add", "method", 4), ("Box", "put", "method", 4), ("", "lone", "function", 1)]
    assert [tuple(r) for r in commands.dry(source, nodes=5).collect()] == [(1.0, "src/box.py", 3, "src/box.py", 10)]
    names = lambda *x: spark.createDataFrame([(f,) for f in x], "path string")
    found = commands.duplicates(source, names("src/box.py"), nodes=5)
    assert found.candidates.count() == 1 and [tuple(r) for r in found.groups.select("size", "file", "start_line").collect()] == [(2, "src/box.py", 3), (2, "src/box.py", 10)]
    assert sorted((r["start_line"], r["duplicates"]) for r in found.counts.where("duplicates > 0").collect()) == [(3, 1), (10, 1)]
    assert commands.duplicates(source, names("src/other.py"), nodes=5).candidates.count() == 0


def test_crap(spark):
    source = files(spark, src__box=CODE, src__bare="def bare():\n    return 1\n")
    assert {r["band"] for r in commands.crap(source).collect()} == {"unknown"}
    segments = spark.createDataFrame([("src/box.py", False, "", i, n, n, 1.0, c, c > 0, 1) for i, (n, c) in enumerate([(4, 1.0), (5, 1.0), (11, 0.0), (12, 0.0)])], "file string, is_branch boolean, key string, ord int, start int, end int, total double, covered double, ran boolean, from_mask int")
    got = commands.crap(source, segments)
    assert [(r["name"], r["coverage"], r["crap"]) for r in got.collect()] == [("put", 0.0, 20.0), ("add", 1.0, 4.0), ("bare", 0.0, 2.0), ("lone", None, None)]
    assert [r["name"] for r in commands.crap(source, segments, spark.createDataFrame([("src/bare.py",)], "path string")).collect()] == ["bare"]
    gaps = spark.createDataFrame([("pkg", "go", "no tests"), ("pkg", "go", "no tests")], "dir string, language string, why string")
    found = crap_.gate(got, 3.0, gaps).collect()
    assert [(r["rule"], r["place"], r["detail"], r["crap"]) for r in found] == [("coverage", "pkg", "go: no tests", None), ("crap", "src/box.py:10", "Box#put", 20.0), ("crap", "src/box.py:3", "Box#add", 4.0)]
    assert commands.exit_code(crap_.gate(got, 50.0, gaps)) == 1 and commands.exit_code(crap_.gate(got, 50.0, gaps.limit(0))) == 0
    assert commands.exit_code(crap_.problems(got, 19.0)) == 1 and commands.exit_code(crap_.problems(got, 20.0)) == 0


def test_scrap(spark):
    case = "def test_{0}():\n    x = make({0})\n    assert x.value == {0}\n    assert x.name == 'n'\n"
    details, report = commands.scrap(files(spark, test_many="".join(case.format(i) for i in range(4)), test_a=TESTS))
    assert details.count() == 8
    got = {r["file"]: r for r in report.collect()}
    assert got["test_many.py"]["examples"] == 4 and got["test_many.py"]["pressure"] == 1.5


def test_empty(spark):
    none = files(spark, src__a="").where("false")
    for made in (commands.units(none), commands.crap(none), commands.dry(none), *commands.scrap(none), commands.routes(none), commands.modules(none), *commands.duplicates(none), commands.module_graph(none, "r").edges):
        assert made.count() == 0


def test_statement_lines(spark):
    body = "x = [\n    1,\n    f(\n        2),\n]\nif a and (\n        b):\n    return_(\n        3)\n"
    got = syntax.statement_lines(python_code.parse(files(spark, src__s=body)))
    assert {r["text"]: (r["start_line"], r["statement_line"]) for r in got.where("kind IN ('literal', 'identifier')").collect()} == {
        "x": (1, 1), "1": (2, 1), "f": (3, 1), "2": (4, 1), "a": (6, 6), "b": (7, 6), "return_": (8, 8), "3": (9, 8),
    }


def test_module_graph(spark):
    sources = files(
        spark,
        shop__init="", app__api__init="", app__api__users='import os\nfrom ..core.model import User\nfrom app import core\n\n@app.get("/users/{id}")\ndef one(id):\n    return id and 1\n',
        app__core__model="import app.api.users\nimport json\n\nclass User:\n    def name(self):\n        return 1\n",
        client__deep__only="import requests\n\ndef ask():\n    requests.get(\"http://h/users/7\")\n", tests__test_x="import os\n",
    ).withColumn("path", F.regexp_replace("path", "init.py$", "__init__.py"))
    made = commands.module_graph(sources, "repo")
    nodes = {r["id"]: r for r in made.nodes.collect()}
    assert {k: (r["kind"], r["parent"]) for k, r in nodes.items()} == {
        "repo": ("repo", None), "repo/shop": ("module", "repo"), "repo/app": ("dir", "repo"), "repo/app/api": ("module", "repo/app"), "repo/app/api/users": ("module", "repo/app/api"), "repo/app/core": ("dir", "repo/app"),
        "repo/app/core/model": ("module", "repo/app/core"), "repo/client": ("dir", "repo"), "repo/client/deep": ("dir", "repo/client"), "repo/client/deep/only": ("module", "repo/client/deep"),
    }
    users = nodes["repo/app/api/users"]
    assert (users["files"], users["serves"], users["calls"]) == (["app/api/users.py"], ["GET /users/*"], []) and "os" in users["external"]
    assert nodes["repo/client/deep/only"]["calls"] == ["GET /users/7"] and nodes["repo"]["functions"] == 3 and nodes["repo/shop"]["functions"] == 0 and nodes["repo/app"]["files"] == []
    edges = sorted((r["src"], r["dst"], r["kind"], r["count"], r["via"]) for r in made.edges.collect())
    assert edges == [("repo/app/api/users", "repo/app/core/model", "import", 1, []), ("repo/app/core/model", "repo/app/api/users", "import", 1, []), ("repo/client/deep/only", "repo/app/api/users", "http", 1, ["GET /users/*"])]
    assert tuple(made.totals.select("repositories", "modules", "functions", "edges").first()) == (1, 5, 3, 3)
    boxes, arrows, sides = commands.graph_view(made, "repo")
    assert sorted(tuple(r) for r in boxes.collect()) == [("repo/app", "repo/app", "app", "dir", False), ("repo/client/deep/only", "repo/client/deep/only", "client/deep/only", "module", False), ("repo/shop", "repo/shop", "shop", "module", False)]
    assert [tuple(r) for r in arrows.select("from_box", "to_box", "kind", "count", "pairs", "via", "cycle").collect()] == [("repo/client/deep/only", "repo/app", "http", 1, 1, ["GET /users/*"], False)]
    _, arrows, sides = commands.graph_view(made, "repo/app")
    assert sorted((r["from_box"], r["to_box"], r["cycle"]) for r in arrows.collect()) == [("repo/app/api", "repo/app/core/model", True), ("repo/app/core/model", "repo/app/api", True)]
    assert sorted((r["box"], r["incoming"], r["outgoing"]) for r in sides.collect()) == [("repo/app/api", 1, 0), ("repo/app/core/model", 0, 0)]
