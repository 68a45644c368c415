"""Operators on hand-made rows, and properties against plain Python."""

import random

import pytest

from loupe.operators import coverage, graph, history, selection, similarity, testshape


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


SEGMENT = "file string, is_branch boolean, ord int, start int, end int, total double, covered double, key string, ran boolean, from_mask int"


def test_merge_segments(spark):
    s = spark.createDataFrame(
        [("f", False, 1, 3, 3, 1.0, 0.0, "3", False, 1), ("f", False, 2, 4, 4, 9.0, 1.0, "3", True, 2), ("f", False, 3, 5, 5, 1.0, 1.0, "", True, 1), ("f", False, 4, 5, 5, 1.0, 1.0, "", True, 1)], SEGMENT
    )
    got = coverage.merge_segments(s)
    assert rows(got, "key", "start", "total", "covered", "ran", "from_mask") == [("", 5, 1.0, 1.0, True, 1), ("", 5, 1.0, 1.0, True, 1), ("3", 3, 1.0, 1.0, True, 3)]
    assert rows(coverage.merge_segments(got.select(*[c.split()[0] for c in SEGMENT.split(", ")]))) == rows(got)


def test_range_share_prefers_branches_and_skips(spark):
    s = spark.createDataFrame([("f", False, i, n, n, 1.0, float(c), str(n), c > 0, 1) for i, (n, c) in enumerate([(2, 1), (3, 0), (4, 1), (9, 1)])] + [("g", True, 0, 2, 2, 2.0, 1.0, "2,0", True, 1), ("g", False, 1, 2, 2, 1.0, 1.0, "2", True, 1)], SEGMENT)
    r = spark.createDataFrame([("f", 1, 1, 5), ("f", 2, 5, 8), ("f", 3, 1, 5), ("g", 4, 1, 5)], "file string, id int, low int, high int")
    skip = spark.createDataFrame([("f", 3, 3, 3)], "file string, id int, skip_low int, skip_high int")
    assert [(i, s and round(s, 4)) for i, s in rows(coverage.range_share(r, s, skip), "id", "share")] == [(1, 0.6667), (2, None), (3, 1.0), (4, 0.5)]


def test_site_line_and_paths(spark):
    sites = spark.createDataFrame([("f", 1, 5, 3), ("f", 2, 5, 5), ("f", 3, 2, 1)], "file string, id int, line int, statement int")
    measured = spark.createDataFrame([("f", 4), ("f", 3), ("f", 6)], "file string, line int")
    assert rows(coverage.site_line(sites, measured), "id", "measured_line") == [(1, 4), (2, 5), (3, 2)]
    reported = spark.createDataFrame([("x/b/c.go",), ("c.go",), ("a/b/c.go",), ("z.go",)], "path string")
    sources = spark.createDataFrame([("a/b/c.go",), ("q/c.go",)], "path string")
    assert dict(rows(coverage.match_paths(reported, sources)))["c.go"] is None


def test_report_paths(spark):
    def match(path, sources, base=""):
        return coverage.match_paths(spark.createDataFrame([(path,)], "path string"), spark.createDataFrame([(x,) for x in sources], "path string"), base).first()["source"]

    assert match("a/b.py", ["a/b.py", "x/a/b.py"]) == "a/b.py"
    assert match("util.py", ["/p/a/util.py", "/p/b/util.py"], "/elsewhere") is None
    assert match("util.py", ["/p/a/util.py", "/p/b/util.py"], "/p/a") == "/p/a/util.py"
    assert match("C:\\w\\a\\c.py", ["a/c.py", "b/c.py"]) == "a/c.py"
    assert match("file:///p/x/../a/util.py", ["/p/a/util.py", "/p/b/util.py"], "/q") == "/p/a/util.py"
    assert match("example.com/mod/src/a.go", ["/r/src/a.go", "/r/a.go"], "/r") == "/r/src/a.go"
    assert match("../up.py", ["../up.py", "up.py"]) == "../up.py" and match("none.py", ["a.py"]) is None


def test_site_line_of_ties_and_other_files(spark):
    sites = spark.createDataFrame([("f", 1, 5, 1, "x"), ("f", 2, 5, 1, "y"), ("g", 3, 5, 1, "z")], "file string, id int, line int, statement int, at string")
    measured = spark.createDataFrame([("f", 5), ("f", 5), ("h", 4)], "file string, line int")
    got = coverage.site_line(sites, measured)
    assert got.columns == [*sites.columns, "measured_line"] and rows(got, "id", "measured_line") == [(1, 5), (2, 5), (3, 5)]


def test_similar_pairs_equal_brute_force(spark):
    r = random.Random(3)
    sets = [(i, r.choice("ab"), sorted({r.randint(0, 12) for _ in range(r.randint(1, 9))})) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, part string, tokens array<int>")
    for t in (0.5, 0.82, 1.0):
        want = sorted((x[0], y[0]) for x in sets for y in sets if x[0] < y[0] and x[1] == y[1] and len({*x[2]} & {*y[2]}) / len({*x[2]} | {*y[2]}) >= t)
        assert rows(similarity.similar_pairs(df, t), "a", "b") == want


def test_classes_stand_for_their_copies(spark):
    r = random.Random(5)
    base = [(i, "ab"[i % 2], sorted({r.randint(0, 40) for _ in range(r.randint(1, 25))})) for i in range(120)]
    near = [(200 + i, p, sorted({*t, 41 + i % 3})) for i, p, t in base[:60]]
    copies = [(400 + 60 * k + i, p, t) for k in range(3) for i, p, t in (base + near)[60:120]]
    sets = base + near + copies + [(900, "a", []), (901, "a", None), (902, None, [1])]
    df = spark.createDataFrame(sets, "id int, part string, tokens array<int>")
    like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    for t in (0.05, 0.5, 0.82, 1.0):
        want = {(x[0], y[0]): like(x[2], y[2]) for x in sets for y in sets if x[2] and y[2] and x[0] < y[0] and x[1] == y[1] and like(x[2], y[2]) >= t}
        assert {(x["a"], x["b"]): x["score"] for x in similarity.similar_pairs(df, t).collect()} == pytest.approx(want)
        some = similarity.similar_pairs(df, t, df.where("id % 9 = 0")).collect()
        assert sorted((x["a"], x["b"]) for x in some) == sorted(p for p in want if p[0] % 9 == 0 or p[1] % 9 == 0)
        pairs, members = similarity.similar_classes(df, t)
        reps = {x["id"]: x["rep"] for x in members.collect()}
        assert reps == {x[0]: min(y[0] for y in sets if y[2] == x[2] and y[1] == x[1]) for x in sets if x[1] and x[2]}
        assert {(x["a"], x["b"]) for x in pairs.collect()} == {p for p in want if reps[p[0]] == p[0] and reps[p[1]] == p[1] and want[p] < 1}


def test_groups_of_many_copies_make_no_pairs(spark):
    copies = spark.range(3_000).selectExpr("id", "'p' AS part", "array('x', 'y', concat('z', id div 2999)) AS tokens")
    links = similarity.with_copies(*similarity.similar_classes(copies, 0.5))
    assert links.count() == 2_999
    assert rows(similarity.groups(links), "root", "size", "min_score", "max_score") == [(0, 3_000, 0.5, 1.0)]


def test_groups_and_focus(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 1.0), (5, 6, 0.95)], "a int, b int, score double")
    assert rows(similarity.groups(pairs), "root", "size", "min_score", "max_score") == [(1, 3, 0.9, 1.0), (5, 2, 0.95, 0.95)]
    assert rows(similarity.focus(pairs, spark.createDataFrame([(3,)], "id int")), "a", "b") == [(2, 3)]
    assert similarity.groups(pairs.limit(0)).count() == 0
    sets = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [2, 3])], "id int, tokens array<int>")
    got = similarity.cluster(pairs.where("a < 5"), sets).first()
    assert got["size"] == 3 and got["similarity"] == pytest.approx((1 + 1 / 3 + 1 / 3) / 3)


def test_cluster_means_by_blocks(spark):
    r = random.Random(8)
    sets = [(i, sorted({r.randint(0, 30) for _ in range(r.randint(1, 12))})) for i in range(90)]
    sets += [(100 + i, sets[i % 3][1]) for i in range(40)]
    df = spark.createDataFrame(sets, "id int, tokens array<int>")
    chain = [(a[0], b[0]) for a, b in zip(sets, sets[1:], strict=False) if a[0] != 50]
    pairs = spark.createDataFrame(chain, "a int, b int")
    want = []
    for part in (sets[:51], sets[51:]):
        likes = [len({*x[1]} & {*y[1]}) / len({*x[1]} | {*y[1]}) for i, x in enumerate(part) for y in part[:i]]
        want.append((part[0][0], len(part), sum(likes) / len(likes)))
    for limits in ((1024, 1 << 19), (7, 1 << 19), (1024, 60)):
        got = sorted(tuple(x) for x in similarity.cluster(pairs, df, *limits).collect())
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    alike = spark.createDataFrame([(i, ["x", "y"]) for i in range(5)], "id int, tokens array<string>")
    one = similarity.cluster(spark.createDataFrame([(0, i) for i in range(1, 5)], "a int, b int"), alike).collect()
    assert [tuple(x) for x in one] == [(0, 5, 1.0)]


def test_components_reach_and_cycles(spark):
    r = random.Random(1)
    edges = sorted({(r.randint(0, 40), r.randint(0, 40)) for _ in range(45)})
    df = spark.createDataFrame(edges, "src int, dst int")
    reach = {n: {n} for e in edges for n in e}
    for _ in range(50):
        for a, b in edges:
            for x in reach.values():
                if a in x:
                    x.add(b)
    assert rows(graph.reach(df.select("src"), df), "start", "node") == sorted((a, b) for a in {a for a, _ in edges} for b in reach[a])
    scc = {n: min(m for m in reach[n] if n in reach[m]) for n in reach if any(m != n and n in reach[m] for m in reach[n])}
    assert rows(graph.cycles(df), "node", "cycle") == sorted(scc.items())
    parent = {n: n for n in reach}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert rows(graph.components(df), "node", "root") == sorted((n, find(n)) for n in {n for a, b in edges if a != b for n in (a, b)})
    assert graph.components(df.limit(0)).count() == 0


def test_http_edges(spark):
    calls = spark.createDataFrame([("a", "GET", "/users/42"), ("a", "GET", "/users/42"), ("a", "POST", "/users/1"), ("b", "", "/users/7"), ("c", "DELETE", "/any"), ("a", "GET", "/users/1/2")], "module string, method string, path string")
    serves = spark.createDataFrame([("b", "GET", "/users/*"), ("d", "", "/any")], "module string, method string, path string")
    assert rows(graph.http_edges(calls, serves)) == [("a", "b", 2, "GET /users/*"), ("c", "d", 1, "/any")]


def test_roll_up_root_is_the_sum_of_leaves(spark):
    units = spark.createDataFrame([("a/x", 3.0, 1, 0, 0, 0, 0), ("a/y", 40.0, 0, 2, 1, 1, 2), ("b", None, 4, 0, 0, 0, 0)], "path string, crap double, killed int, survived int, uncovered int, stale int, duplicates int")
    got = {r["node"]: r for r in graph.roll_up(units).collect()}
    assert (got["(root)"]["functions"], got["(root)"]["killed"], got["(root)"]["unknown"], got["(root)"]["max_crap"]) == (3, 5, 1, 40.0)
    assert got["a/x"]["crap_grade"] == 10.0 and got["a/y"]["crap_grade"] == 1.0 and got["a"]["crap_grade"] == 1.0 and got["b"]["crap_grade"] is None


def test_contract_prefix_and_collapse(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("c", "b", 1), ("a", "c", 5)], "src string, dst string, count int")
    boxes = spark.createDataFrame([("a", "X"), ("c", "X"), ("b", "Y")], "node string, box string")
    assert rows(graph.contract(edges, boxes)) == [("X", "Y", 3, 2)]
    paths_ = spark.createDataFrame([("a/b/c",), ("q",)], "path string")
    assert rows(graph.nearest_prefix(paths_, spark.createDataFrame([("a",), ("a/b",)], "marker string"))) == [("a/b/c", "a/b"), ("q", None)]
    tree = spark.createDataFrame([("a", "", True), ("a/b", "a", True), ("a/b/c", "a/b", True), ("a/b/d", "a/b", True)], "node string, parent string, is_dir boolean")
    assert ("a", "a/b") in rows(graph.collapse_single(tree), "node", "shown")


def test_history(spark):
    old = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c")], "id string, ord int, hash string")
    new = spark.createDataFrame([("f", 1, "b"), ("f", 2, "x"), ("f", 3, "b")], "id string, ord int, hash string")
    assert rows(history.pair_by_hash(old, new)) == [("f", 1, 2, False), ("f", 2, 1, True), ("f", 3, 3, False)]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "key int, hash string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "key int, hash string")
    assert rows(history.hash_diff(a, b)) == [(1, "removed"), (2, "changed"), (3, "same"), (4, "added")]
    trials = spark.createDataFrame([(1, "killed", 1, "timeout"), (2, "killed", 1, "survived"), (2, "killed", 2, "killed"), (3, "killed", 1, "survived"), *((4, "killed", i, "survived") for i in range(3))], "id int, recorded string, ord int, outcome string")
    assert rows(history.trial_verdicts(trials), "id", "verdict") == [(1, "agreed"), (2, "flaky"), (3, "pending"), (4, "mismatched")]
    assert rows(history.settled(trials), "id", "state") == [(1, "pending"), (2, "flaky"), (3, "pending"), (4, "agreed")]


def test_draw_does_not_depend_on_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    a = [r["k"] for r in history.draw(df.repartition(7), "s", ["k"], 10).collect()]
    assert a == [r["k"] for r in history.draw(df.coalesce(1), "s", ["k"], 10).collect()]
    assert a != [r["k"] for r in history.draw(df, "t", ["k"], 10).collect()]


def test_selection(spark):
    p = spark.createDataFrame([("src/a.go",), ("lib/b.go",), ("c.py",)], "path string")
    assert rows(selection.select_fragments(p, ["b", "go"])) == [("lib/b.go", "b"), ("src/a.go", "go")]
    assert selection.select_fragments(p, []).count() == 0
    assert selection.unmatched_fragments(p, ["go", "zz"]) == ["zz"]
    u = spark.createDataFrame([("f", "u1", "h1", 1, 5), ("f", "u2", "h2", 6, 9), ("f", "u3", "h3", 10, 12)], "file string, id string, hash string, start_line int, end_line int")
    r = spark.createDataFrame([("f", 5, 6)], "file string, start int, end int")
    assert rows(selection.touched(u, r), "id") == [("u1",), ("u2",)]
    assert rows(selection.changed_functions(u, r, spark.createDataFrame([("u1", "h1")], "id string, hash string")), "id") == [("u2",)]


def test_exceptions_renew(spark):
    stale = spark.createDataFrame([(1, "f", "g", "a>b", "x = 1", 3, 1), (2, "f", "g", "c>d", None, 9, 9), (3, "f", "g", "q>r", None, 1, 1), (4, "f", "g", "e>f", "y", 5, 5)], "id int, file string, function string, change string, line_text string, line int, column int")
    sites = spark.createDataFrame([("f", "g", "a>b", "x=1", 7, 2), ("f", "g", "a>b", "z", 3, 1), ("f", "g", "c>d", "k", 4, 4), ("f", "g", "e>f", "y", 6, 1), ("f", "g", "e>f", " y", 7, 1)], "file string, function string, change string, text string, line int, column int")
    assert rows(selection.renew_exceptions(stale, sites)) == [(1, "renewed", 7, 2), (2, "renewed", 4, 4), (3, "gone", None, None), (4, "ambiguous", None, None)]


def test_actions(spark):
    from pyspark.sql import functions as F

    from loupe.functions import scores

    def act(*of):
        return spark.range(1).select(scores.action(*(F.lit(x) for x in of)).alias("a")).first()["a"]

    assert [act(3, 0, 0, 0, 0, 0), act(3, 0, 0, 0, 1, 0), act(3, 1, 1, 0, 0, 0), act(4, 0, 0, 3, 0, 0), act(25, 5, 3, 0, 0, 0)] == ["LEAVE_ALONE", "AUTO_TABLE_DRIVE", "AUTO_REFACTOR", "REVIEW_FIRST", "MANUAL_SPLIT"]
    details = testshape.scored(spark.createDataFrame([("f", 1, "g", "a", 40, 1, 4, 0), ("f", 2, "g", "b", 5, 0, 0, 1)], "file string, ord int, group string, name string, lines int, decisions int, mocks int, assertions int"))
    assert [(r["confidence"], r["advice"]) for r in testshape.recommendations(details).orderBy("nth").collect()] == [("HIGH", "no-assertions"), ("HIGH", "large"), ("MEDIUM", "logic"), ("MEDIUM", "mock-heavy")]
