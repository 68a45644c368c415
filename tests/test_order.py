"""Sizes, orders, places and names against rows worked out by hand."""

import hashlib
import random

from pyspark.sql import functions as F

from loupe import sinks
from loupe.functions import paths
from loupe.operators import coverage, graph, history, selection, similarity


def column(spark, expression, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema).select(expression).collect()]


def test_large_enough(spark):
    units = spark.createDataFrame([(1, 1, 4, 20), (2, 1, 3, 50), (3, 1, 9, 19)], "id int, start_line int, end_line int, nodes int")
    assert [r["id"] for r in similarity.large_enough(units).collect()] == [1]


def test_candidates_and_groups(spark):
    units = spark.createDataFrame([(1, "b", 5), (2, "a", 100), (3, "a", 9), (4, "c", 1), (5, "c", 2)], "id int, file string, start_line int")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8304999), (4, 5, 0.9)], "a int, b int, score double")
    found = similarity.candidates(pairs, units)
    assert [tuple(r) for r in found.collect()] == [(0.9, "a", 100, "b", 5), (0.9, "c", 1, "c", 2), (0.83, "a", 9, "a", 100)]
    groups = similarity.group_members(pairs, units).collect()
    assert [(r["size"], r["max_score"], r["first_file"], r["first_line"], r["file"], r["start_line"]) for r in groups] == [
        (3, 0.9, "a", 9, "a", 9), (3, 0.9, "a", 9, "a", 100), (3, 0.9, "a", 9, "b", 5), (2, 0.9, "c", 1, "c", 1), (2, 0.9, "c", 1, "c", 2)]
    counts = similarity.duplicate_counts(units.union(spark.createDataFrame([(6, "z", 1)], units.schema)), found)
    assert {r["id"]: r["duplicates"] for r in counts.collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 0}
    assert similarity.candidates(pairs.limit(0), units).count() == 0


def test_attach(spark):
    rows = [("o/r", "repo", "o/r"), ("o/r/(root)", "module", "(root)"), ("o/r/a/b/c", "module", "c"), ("o/r/a", "module", "a"), ("o/r/z", "module", "B")]
    nodes = graph.attach(spark.createDataFrame(rows, "id string, kind string, label string"), "o/r")
    got = {r["id"]: (r["kind"], r["label"], r["parent"]) for r in nodes.collect()}
    assert got["o/r"][2] is None and got["o/r/(root)"][2] == got["o/r/a"][2] == got["o/r/z"][2] == "o/r"
    assert got["o/r/a/b"] == ("dir", "b", "o/r/a") and got["o/r/a/b/c"][2] == "o/r/a/b" and len(got) == 6
    assert [r["label"] for r in graph.children(nodes, "sys").where("parent = 'o/r'").collect()] == ["(root)", "B", "a"]
    assert [r["id"] for r in graph.children(nodes, "sys").where("parent = 'sys'").collect()] == ["o/r"]
    edges = spark.createDataFrame([("b", "a"), ("a", "c"), ("a", "b")], "src string, dst string")
    units = spark.createDataFrame([("n", "f", 10), ("n", "f", 9), ("n", "e", 11)], "node string, file string, line int")
    assert tuple(graph.totals(nodes, units, edges).first()) == (1, 4, 3, 3)
    named, placed, linked = graph.in_order(nodes.withColumn("external", F.array(F.lit("y"), F.lit("x"))), units, edges)
    assert [r["id"] for r in named.collect()] == sorted(got) and named.first()["external"] == ["x", "y"]
    assert [tuple(r) for r in placed.collect()] == [("n", "e", 11), ("n", "f", 9), ("n", "f", 10)] and [tuple(r) for r in linked.collect()] == [("a", "b"), ("a", "c"), ("b", "a")]


def test_union_in_order(spark):
    lists = [spark.createDataFrame([(p,) for p in x], "path string") for x in (["b", "d"], ["a", "b", "c"])]
    assert [r["path"] for r in selection.union_in_order(*lists).collect()] == ["b", "d", "a", "c"]


def test_judged_lines(spark):
    spans = [("3.5,7.1", 1, (3, 6)), ("3.5,7.2", 1, (3, 7)), ("3.5,3.1", 1, (3, 3)), ("", 4, (4, 4)), (None, 4, (4, 4)), ("9.1,3.1", 5, (5, 5)), ("x,2.1", 6, (6, 6)), ("3,8", 1, (3, 8))]
    blocks = spark.createDataFrame([("f", s, n) for s, n, _ in spans], "file string, span string, line int")
    assert [tuple(r[0]) for r in blocks.select(selection.block_lines(F.col("span"), F.col("line"))).collect()] == [x for *_, x in spans]
    ranges = spark.createDataFrame([("f", 7, 7), ("g", 1, 99)], "file string, start int, end int")
    assert [r["span"] for r in selection.judged_lines(blocks, ranges).collect()] == ["3.5,7.2", "3,8"] and selection.judged_lines(blocks).count() == len(spans)


def test_names(spark):
    assert column(spark, paths.relative_key("/w/p", F.col("x")), "/w/p/a/b.go", "/w/pq/a", "/w/p", "/w/p/../q", "/w/p\\c.go") == ["a/b.go", "/w/pq/a", ".", "/w/q", "c.go"]
    assert column(spark, sinks.one_line(F.col("x")), " a\n\tb  c ", "", None) == ["a b c", "", None]
    names = sinks.comment_name(F.col("n"), F.col("s"), F.col("f"))
    assert column(spark, names, ("go", "m", "m"), ("count", "m.Board", "m"), ("name", "m.Outer.Inner", "m"), ("x", "Other", "m"), schema="n string, s string, f string") == ["go", "Board#count", "Outer.Inner#name", "Other#x"]


def test_http_edges_against_all_pairs(spark):
    r, schema = random.Random(1), "module string, method string, path string"

    def some(n):
        return [(f"m{r.randrange(5)}", r.choice(["", "GET", "POST"]), "/" + "/".join(r.choice("*abc") for _ in range(r.randint(1, 4)))) for _ in range(n)]

    def fits(p, q):
        return len(p) == len(q) and all(x == y or "*" in (x, y) for x, y in zip(p, q))

    calls, serves, want = some(300), some(100), {}
    for a, how, p in calls:
        for b, served, q in serves:
            if a != b and (not how or not served or how == served) and fits(p.split("/"), q.split("/")):
                want[a, b] = want.get((a, b), 0) + 1
    got = graph.http_edges(spark.createDataFrame(calls, schema), spark.createDataFrame(serves, schema)).collect()
    assert {(x["src"], x["dst"]): x["count"] for x in got} == want


def test_pairs_of_some_sets(spark):
    r = random.Random(2)
    sets = [(i, i % 2, [str(r.randrange(9)) for _ in range(12)]) for i in range(60)] + [(99, None, ["1"]), (98, None, ["1"])]
    df = spark.createDataFrame(sets, "id int, part int, tokens array<string>")
    every = {(x["a"], x["b"]) for x in similarity.similar_pairs(df, 0.7).collect()}
    some = similarity.similar_pairs(df, 0.7, df.where("id % 7 = 0")).collect()
    assert sorted((x["a"], x["b"]) for x in some) == sorted(p for p in every if p[0] % 7 == 0 or p[1] % 7 == 0) and some
    assert not [p for p in every if p[0] > 90]


def test_fresh_plan(spark):
    sites = spark.createDataFrame([("a\\b", str(i)) for i in range(20)], "path string, identity string")
    plan = history.fresh_plan(sites, "s", 5).orderBy("rank").collect()
    assert [x["selected"] for x in plan] == [True] * 5 + [False] * 15
    assert all(x["rank"] == hashlib.sha256(f"fresh-plan-v2\0s\0a/b\0{x['identity']}".encode()).hexdigest() for x in plan)
    assert {x["identity"] for x in history.fresh_plan(sites.repartition(7), "s", 5).where("selected").collect()} == {x["identity"] for x in plan[:5]}


def test_ranges_of_several_blocks(spark):
    r = random.Random(4)
    ranges = [(f"f{i % 3}", i, a, a + r.choice([0, 5, 255, 256, 900, -3])) for i in range(40) for a in [r.randrange(1500)]] + [("f0", 99, None, 4)]
    segments = [(f"f{r.randrange(3)}", False, s, s + r.choice([0, 1, 700]), 1.0, float(r.random() < 0.5), r.random() < 0.5, r.choice([1, 2])) for s in (r.randrange(1600) for _ in range(150))]
    df = spark.createDataFrame(segments, "file string, is_branch boolean, start int, end int, total double, covered double, ran boolean, from_mask int")
    got = {x["id"]: x["share"] for x in coverage.range_share(spark.createDataFrame(ranges, "file string, id int, low int, high int"), df).collect()}
    for f, i, low, high in ranges:
        own = [x for x in segments if x[0] == f and low is not None and low <= x[2] <= high]
        assert got[i] == (sum(x[5] for x in own) / len(own) if own else None)
    lines = [("f1", n) for n in range(0, 2400, 7)]
    over = {x["line"]: (x["executed"], x["in_process"], x["integration"]) for x in coverage.line_sources(spark.createDataFrame(lines, "file string, line int"), df).collect()}
    want = {}
    for f, n in lines:
        if own := [x for x in segments if x[0] == f and x[2] <= n <= x[3]]:
            want[n] = (any(x[6] for x in own), any(x[6] and x[7] == 1 for x in own), any(x[6] and x[7] == 2 for x in own))
    assert over == want
