"""Readers: coverage reports, diffs, listings, snapshots and Python code."""

from loupe.operators import syntax
from loupe.sources import python_code, reports, snapshots


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def texts(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "report int, text string")


def test_lcov(spark):
    body = "TN:\nSF:a.py\nDA:2,1\nDA:3,0\nDA:4,5\nDA:x\nBRDA:5,0,0,1\nBRDA:5,0,1,-\nBRDA:6,0,0,1\nend_of_record\nDA:9,1\nSF:b.py\nDA:1,0\nend_of_record\n"
    got = reports.read_lcov(texts(spark, body))
    assert rows(got, "file", "is_branch", "start", "total", "covered") == [("a.py", False, 2, 1.0, 1.0), ("a.py", False, 3, 1.0, 0.0), ("a.py", False, 4, 1.0, 1.0), ("a.py", True, 5, 2.0, 1.0), ("b.py", False, 1, 1.0, 0.0)]


def test_go_cover(spark):
    got = reports.read_go_cover(texts(spark, "mode: set\nm/a.go:3.2,5.9 2 1\nm/a.go:6.2,6.9 1 0\nC:/m/b.go:1.1,1.2 0 3\n"))
    assert rows(got, "file", "start", "end", "total", "covered", "ran") == [("C:/m/b.go", 1, 1, 0.0, 0.0, True), ("m/a.go", 3, 5, 2.0, 2.0, True), ("m/a.go", 6, 6, 1.0, 0.0, False)]


def test_jacoco(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<report name="x"><package name="p/q"><sourcefile name="A.kt"><line nr="3" mi="1" ci="3" mb="1" cb="1"/><line nr="4" mi="1" ci="3" mb="0" cb="0"/></sourcefile></package></report>')
    got = reports.read_jacoco(spark, str(tmp_path / "r.xml"))
    assert rows(got, "file", "is_branch", "start", "total", "covered") == [("p/q/A.kt", False, 3, 4.0, 3.0), ("p/q/A.kt", False, 4, 4.0, 3.0), ("p/q/A.kt", True, 3, 2.0, 1.0)]


def test_sniff(spark):
    got = spark.createDataFrame([("mode: set",), (" <report/>",), ("TN:",)], "t string").select(reports.sniff(__import__("pyspark").sql.functions.col("t")).alias("k"))
    assert [r["k"] for r in got.collect()] == ["go", "xml", "lcov"]


def test_diff(spark):
    body = 'diff --git a/x b/y\nrename from x\nrename to y\n--- a/x\n+++ b/y\n@@ -1 +2,3 @@\n+++ b/fake\n@@ -9,2 +8,0 @@\n-gone\ndiff --git a/z b/z\ndeleted file mode 100644\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n'
    assert rows(reports.read_diff(texts(spark, body))) == [("y", 2, 4, False), ("y", 8, 9, True)]
    assert rows(reports.read_renames(texts(spark, body))) == [("y", "x")]


def test_listing(spark):
    assert rows(reports.read_listing(texts(spark, "a\tf.py\tx1\n\nb\n")), "id", "file", "fingerprint") == [("a", "f.py", "x1"), ("b", "", "")]


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2.5)], "name string, crap double")
    path = str(tmp_path / "deep" / "crap.json")
    snapshots.write_snapshot(df, path, "entries")
    got = snapshots.read(spark, path, snapshots.CRAP).selectExpr("version", "inline(entries)").collect()
    assert [(r["version"], r["name"], r["crap"]) for r in got] == [(1, "a", None), (1, "b", 2.5)]
    assert snapshots.read(spark, path + ".none", snapshots.CRAP) is None
    assert snapshots.envelope(df.limit(0), df.limit(0)) == {"schema": 1, "ok": True, "result": [], "problems": []}
    snapshots.remove(path, str(tmp_path))
    assert not (tmp_path / "deep").exists()


CODE = '''
import os, a.b
from ..pkg import thing as t, other

def charge(orders, rate):
    total = 0
    for order in orders:
        if order.paid or order.void:
            continue
        try:
            total += order.amount if rate is None else order.amount * rate
        except (TypeError, KeyError):
            total += 0
    while total > 100 and rate:
        total -= rate
    match total:
        case 0:
            return None
        case 1 | 2:
            return 1
    return {o.id for o in orders if o.late}, total

class Box:
    def _get(self):
        # a comment
        return fetch(self.x, True)
    def _get(self):
        def inner():
            return 0
        return inner
'''
RENAMED = "def _get(self):\n    return fetch(self.y, False)\n"


def test_python_code(spark):
    nodes = python_code.parse(spark.createDataFrame([("m.py", CODE.encode()), ("n.py", RENAMED.encode()), ("bad.py", b"def (")], "path string, content binary")).cache()
    units = syntax.units(nodes)
    assert rows(units, "file", "ord", "namespace", "name", "kind", "private") == [("m.py", 1, "", "charge", "function", False), ("m.py", 2, "Box", "_get", "method", True), ("m.py", 3, "Box", "_get#2", "method", True), ("n.py", 1, "", "_get", "function", True)]
    assert dict(rows(syntax.complexity(units, nodes).where("file = 'm.py'"), "name", "complexity")) == {"charge": 12, "_get": 1, "_get#2": 1}  # for, if, or, conditional, except, while, and, two cases, comprehension with its filter
    prints = {(r["file"], r["name"]): set(r["prints"]) for r in syntax.fingerprints(units, nodes).join(units.select("file", "pre", "name"), ["file", "pre"]).collect()}
    assert prints["m.py", "_get"] == prints["n.py", "_get"] and prints["m.py", "_get"] != prints["m.py", "_get#2"]
    assert {(r["module"], r["name"]) for r in syntax.imports(nodes).collect()} == {("os", None), ("a.b", None), ("..pkg", "thing"), ("..pkg", "other")}
    assert ("m.py", "Box._get", "True", "False") in rows(syntax.mutation_sites(units, nodes), "file", "unit", "original", "replacement")
    assert syntax.unit_hash(units, nodes).count() == 4
    assert nodes.where("kind = 'error'").count() == 1
