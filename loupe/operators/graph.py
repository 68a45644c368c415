"""Graphs as edge tables: components, closure, cycles, contraction, roll-up and HTTP edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions import scores
from loupe.functions.paths import ancestors
from loupe.operators.tables import cut

#: What a module lists.
FIELDS = ("files", "serves", "calls", "external")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (two columns of one type); root is the component's smallest node.

    Alternates two joins: larger neighbours move to a node's smallest one, then nodes with several
    smaller neighbours pass them to the smallest; ends when every node has one, itself a root.
    """
    a, b = links.columns[:2]
    stars = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    while True:
        own = stars.groupBy("hi").agg(F.min("lo").alias("low"))
        # every node's smallest neighbour among itself and those below and above
        least = stars.select(F.col("hi").alias("n"), F.col("lo").alias("x")).union(stars.select("lo", "lo")).groupBy("n").agg(F.min("x").alias("low"))
        up = stars.join(least, stars["lo"] == least["n"]).select(F.col("hi"), F.col("low").alias("lo"))
        side = stars.join(own, "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        moved = cut(up.union(side).union(own.select("hi", "low")).where("hi <> lo").distinct())
        shrunk = cut(moved.join(moved.groupBy("hi").agg(F.min("lo").alias("low")), "hi").select(F.when(F.col("lo") == F.col("low"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("low").alias("lo")).where("hi <> lo").distinct())
        done = shrunk.count() == stars.count() and shrunk.exceptAll(stars).limit(1).count() == 0
        stars = shrunk
        if done:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(stars.select("lo", "lo").distinct())


def reach(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, node): what each start reaches over edges (src, dst), itself included; at most `hops` edges if given.

    Semi-naive: only pairs found in the last round are extended, so cycles end by themselves.
    """
    seen = frontier = cut(starts.select(F.col(starts.columns[0]).alias("start"), F.col(starts.columns[0]).alias("node")).distinct())
    while hops is None or hops > 0:
        ahead = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(seen, ["start", "node"], "left_anti"))
        if frontier.limit(1).count() == 0:
            break
        seen = cut(seen.union(frontier))
        hops = None if hops is None else hops - 1
    return seen


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes on a cycle of two or more, with the smallest node of their strongly connected component.

    Colours nodes by the smallest node that reaches them; those of a colour that reach its first node
    form its component and leave; repeats on the rest.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while left.limit(1).count():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colour = cut(nodes.select("node", F.col("node").alias("colour")))
        while True:
            passed = left.join(colour, left["src"] == colour["node"]).select(F.col("dst").alias("node"), "colour")
            lower = cut(colour.union(passed).groupBy("node").agg(F.min("colour").alias("colour")))
            changed = lower.join(colour, ["node", "colour"], "left_anti").limit(1).count()
            colour = lower
            if not changed:
                break
        tagged = left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
        inner = cut(tagged.where("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        back = cut(colour.where("node = colour").select("node", "colour"))
        frontier = back
        while frontier.limit(1).count():
            behind = inner.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = cut(behind.join(back, ["node", "colour"], "left_anti"))
            back = cut(back.union(frontier))
        sizes = back.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        here = back.join(sizes, "colour").select("node", F.col("colour").alias("cycle"))
        found = here if found is None else found.union(here)
        gone = back.select("node")
        left = cut(inner.select("src", "dst").join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
    return found if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)


def contract(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Edges (src, dst, count) between boxes (node, box): counts summed, and how many node pairs; none inside a box."""
    src = boxes.select(F.col("node").alias("src"), F.col("box").alias("from_box"))
    dst = boxes.select(F.col("node").alias("dst"), F.col("box").alias("to_box"))
    return edges.join(src, "src").join(dst, "dst").where("from_box <> to_box").groupBy("from_box", "to_box").agg(F.sum("count").alias("count"), F.count("*").alias("pairs"))


def module_edges(imports: DataFrame, index: DataFrame) -> DataFrame:
    """imports (src, target) resolved by index (target, module; the last by ord wins): edges with counts, external targets kept as such."""
    last = index.groupBy("target").agg(F.max_by("module", "ord").alias("module"))
    found = imports.join(last, "target", "left").select("src", F.coalesce("module", F.concat(F.lit("external:"), F.col("target"))).alias("dst"), F.col("module").isNull().alias("external"))
    return found.where("src <> dst").groupBy("src", "dst", "external").agg(F.count("*").alias("count"))


def nearest_prefix(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """paths (path) with the longest marker (marker) that is it or a directory above it; NULL without one."""
    steps = paths.select("path", F.posexplode(ancestors(F.col("path"))).alias("up", "marker"))
    return paths.join(steps.join(markers, "marker").groupBy("path").agg(F.min_by("marker", "up").alias("marker")), "path", "left")


def http_edges(calls: DataFrame, serves: DataFrame) -> DataFrame:
    """Edges from modules that request a route to modules that serve it: as many segments, each equal or a parameter on either side, methods equal where both say.

    calls, serves: module, method (may be empty), path (normalised).  Calls are grouped before the join.
    A route is met at its first segment that is no parameter, by that segment and by *; a request has one row for each of its
    segments, so the two meet once at most.  Routes of parameters alone meet all requests as long, which fit them.
    """
    requests = calls.groupBy("module", "method", "path").agg(F.count("*").alias("n")).select(F.col("module").alias("src"), F.col("method").alias("cm"), F.split("path", "/").alias("c"), "n").withColumn("k", F.size("c"))
    routes = serves.groupBy("module", "method", "path").agg(F.count("*").alias("m")).select(F.col("module").alias("dst"), F.col("method").alias("sm"), F.col("path").alias("route"), F.split("path", "/").alias("s"), "m").withColumn("k", F.size("s"))
    fits = F.forall(F.zip_with("c", "s", lambda x, y: (x == y) | (x == "*") | (y == "*")), lambda x: x)
    at = F.array_position(F.transform("s", lambda x: x != "*"), F.lit(True)).cast("int")
    keys = F.when(at > 0, F.array(*(F.struct(at.alias("at"), x.alias("segment")) for x in (F.get("s", at - 1), F.lit("*"))))).otherwise(F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("segment"))))
    asked = F.concat(F.transform("c", lambda x, i: F.struct((i + 1).alias("at"), x.alias("segment"))), F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("segment"))))
    requests, routes = requests.select("*", F.inline(asked)), routes.select("*", F.inline(keys))
    pairs = requests.join(routes, ["k", "at", "segment"]).where(F.col("src") != F.col("dst")).where((F.col("cm") == "") | (F.col("sm") == "") | (F.col("cm") == F.col("sm"))).where(fits)
    return pairs.groupBy("src", "dst").agg(F.sum(F.col("n") * F.col("m")).alias("count"), F.array_join(F.array_sort(F.collect_set(F.trim(F.concat_ws(" ", "sm", "route")))), ", ").alias("via"))


def roll_up(units: DataFrame) -> DataFrame:
    """Metrics of every directory above the units' paths: units have path, crap (may be NULL), killed, survived, uncovered, stale, duplicates.

    A path itself is a module and graded by its worst CRAP; what stands above it by bands.
    """
    steps = units.select("*", F.posexplode(ancestors(F.col("path"))).alias("up", "node"))
    bands = scores.band(F.col("crap"))
    sums = steps.groupBy("node").agg(
        F.count("*").alias("functions"), *(F.count_if(bands == b).alias(b) for b in ("low", "medium", "high", "unknown")), F.max("crap").alias("max_crap"),
        *(F.sum(c).alias(c) for c in ("killed", "survived", "uncovered", "stale", "duplicates")), (F.max("up") == 0).alias("module"),
    )
    by_band = scores.band_grade(F.col("low"), F.col("medium"), F.col("high"))
    graded = sums.withColumn("crap_grade", F.when(F.col("module") & F.col("max_crap").isNotNull(), scores.crap_grade(F.col("max_crap"))).otherwise(by_band))
    graded = graded.withColumn("mutation_grade", scores.mutation_grade(F.col("killed"), F.col("survived")))
    return graded.withColumn("grade", scores.overall_grade(F.col("crap_grade"), F.col("mutation_grade")))


def collapse_single(children: DataFrame) -> DataFrame:
    """(node, shown): directories (node, parent) whose only child is a directory are shown as that child, down the chain."""
    single = cut(children.groupBy("parent").agg(F.count("*").alias("n"), F.min("node").alias("child"), F.bool_and("is_dir").alias("dirs")).where("n = 1 AND dirs").select(F.col("parent").alias("node"), F.col("child").alias("shown")))
    while True:
        below = single.select(F.col("node").alias("shown"), F.col("shown").alias("next"))
        joined = cut(single.join(below, "shown", "left").select("node", F.coalesce("next", "shown").alias("shown"), F.col("next").isNotNull().alias("moved")))
        single = joined.select("node", "shown")
        if joined.where("moved").limit(1).count() == 0:
            return single


def attach(nodes: DataFrame, repository: str) -> DataFrame:
    """nodes (id, kind, label) and the directories between them and their repository that aren't nodes yet, each with its parent.

    Ids begin with the repository's name and a slash; the module of files at its top, `(root)`, hangs from the repository
    like what has no directory above it.  The repository itself has no parent.
    """
    top = F.lit(repository)
    below = F.regexp_extract("id", r"^(.*)/[^/]*$", 1)
    parent = F.when(F.col("id") == top, F.lit(None).cast("string")).when(F.col("id").endswith("/(root)") | ~below.startswith(repository + "/"), top).otherwise(below)
    known = nodes.select("id", "kind", "label").withColumn("parent", parent)
    above = known.where(F.col("parent") != top).select("parent").distinct()
    depth = F.size(F.split(top, "/"))
    parts = F.split("parent", "/")
    folders = above.select(F.explode(F.transform(F.sequence(depth + 1, F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("id")).distinct()
    missing = folders.join(known.select("id"), "id", "left_anti").select("id", F.lit("dir").alias("kind"), F.substring_index("id", "/", -1).alias("label")).withColumn("parent", parent)
    return known.unionByName(missing)


def module_nodes(facts: DataFrame, repository: str) -> DataFrame:
    """Nodes of a repository from facts (module, field, value): id, kind, label, parent, and a sorted array without repeats for each of files, serves, calls and external.

    Modules come with the repository itself and the folders between; those have empty arrays.  Facts are gathered as sets before
    they are shuffled, so a module that many files name is as cheap as another.
    """
    inside = facts.withColumn("id", F.concat(F.lit(repository + "/"), F.when(F.col("module") == "", "(root)").otherwise(F.col("module"))))
    lists = inside.groupBy("id").agg(*(F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("value")))).alias(f) for f in FIELDS))
    lists = cut(lists)
    top = lists.sparkSession.range(1).select(F.lit(repository).alias("id"), F.lit("repo").alias("kind"), F.lit(repository).alias("label"))
    known = lists.select("id", F.lit("module").alias("kind"), F.substring_index("id", "/", -1).alias("label")).unionByName(top)
    none = F.array().cast("array<string>")
    return attach(known, repository).join(lists, "id", "left").withColumns({f: F.coalesce(f, none) for f in FIELDS})


def level(nodes: DataFrame, units: DataFrame, container: str = "") -> DataFrame:
    """Boxes (box, target, label, kind, self) that are seen inside a container: what stands right below it, and the container itself if it is a module with units.

    nodes: id, kind, label, parent (NULL for a repository, which stands in the container "").  units: node.  A folder with one thing in it is
    shown as that thing, with the labels on the way.
    """
    nodes = nodes.select("id", "kind", "label", F.coalesce("parent", F.lit("")).alias("parent"))
    own = nodes.where((F.col("id") == container) & (F.col("kind") == "module")).join(units.where(F.col("node") == container).select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    only = nodes.groupBy("parent").agg(F.count("*").alias("n"), F.min(F.struct("id", "kind", "label")).alias("child")).where("n = 1").select(F.col("parent").alias("target"), "child")
    shown = cut(nodes.where(F.col("parent") == container).select(F.col("id").alias("target"), "kind", "label"))
    while True:
        deeper = shown.where("kind = 'dir'").join(only, "target")
        moved = cut(deeper.select("target", F.col("child.id").alias("to"), F.col("child.kind").alias("kind"), F.concat_ws("/", "label", "child.label").alias("label")))
        if moved.limit(1).count() == 0:
            break
        shown = cut(shown.join(moved.select("target"), "target", "left_anti").unionByName(moved.select(F.col("to").alias("target"), "kind", "label")))
    boxes = shown.select(F.col("target").alias("box"), "target", "label", "kind", F.lit(False).alias("self"))
    return boxes.unionByName(own.select(F.concat("id", F.lit("#self")).alias("box"), F.col("id").alias("target"), "label", "kind", F.lit(True).alias("self")))


def boxed(nodes: DataFrame, boxes: DataFrame) -> DataFrame:
    """(node, box): the box of a level that each node (id) stands in; nodes outside the level have no row."""
    above = nodes.select(F.col("id").alias("node"), F.explode(ancestors(F.col("id"))).alias("target"))
    below = above.join(boxes.where("NOT self").select("target", "box"), "target").select("node", "box")
    return below.unionByName(boxes.where("self").select(F.col("target").alias("node"), "box"))


def view(edges: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrows (from_box, to_box, kind, count, pairs, via) between boxes, and (box, incoming, outgoing), the counts of edges from and to what is in no box.

    edges: src, dst, kind, count, via (an array or NULL).  places: node, box.  Arrows of one kind between two boxes are one, with counts added
    and all that they go via, sorted; edges inside a box are none.
    """
    ends = [places.select(F.col("node").alias(n), F.col("box").alias(b)) for n, b in (("src", "from_box"), ("dst", "to_box"))]
    met = edges.join(ends[0], "src", "left").join(ends[1], "dst", "left")
    across = met.where("from_box <> to_box")
    arrows = across.groupBy("from_box", "to_box", "kind").agg(F.sum("count").alias("count"), F.count("*").alias("pairs"))
    vias = across.select("from_box", "to_box", "kind", F.explode("via").alias("via")).groupBy("from_box", "to_box", "kind").agg(F.array_sort(F.collect_set("via")).alias("via"))
    arrows = arrows.join(vias, ["from_box", "to_box", "kind"], "left").withColumn("via", F.coalesce("via", F.array().cast("array<string>")))
    one = met.where("(from_box IS NULL) <> (to_box IS NULL)").groupBy(F.coalesce("from_box", "to_box").alias("box"))
    sides = one.agg(*(F.sum(F.when(F.col(c).isNotNull(), F.col("count")).otherwise(0)).alias(n) for c, n in (("to_box", "incoming"), ("from_box", "outgoing"))))
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("incoming", "outgoing")}
    return arrows, places.select("box").distinct().join(sides, "box", "left").withColumns(zero)


def mark_cycles(arrows: DataFrame) -> DataFrame:
    """arrows with `cycle`: whether an import between two boxes lies in a cycle of imports; requests by HTTP make none."""
    found = cycles(arrows.where("kind = 'import'").select(F.col("from_box").alias("src"), F.col("to_box").alias("dst")))
    ends = [found.select(F.col("node").alias(b), F.col("cycle").alias(c)) for b, c in (("from_box", "c1"), ("to_box", "c2"))]
    return arrows.join(ends[0], "from_box", "left").join(ends[1], "to_box", "left").withColumn("cycle", (F.col("kind") == "import") & F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))).drop("c1", "c2")


def children(nodes: DataFrame, system: str = "") -> DataFrame:
    """nodes (id, kind, label, parent) below their parents, by label; repositories and nodes without a parent stand below `system`."""
    return nodes.withColumn("parent", F.when(F.col("kind") == "repo", F.lit(system)).otherwise(F.coalesce("parent", F.lit(system)))).orderBy("parent", "label", "id")


def totals(nodes: DataFrame, units: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: repositories, modules, functions and edges."""
    kinds = nodes.agg(F.count_if(F.col("kind") == "repo").alias("repositories"), F.count_if(F.col("kind") == "module").alias("modules"))
    counts = [units.agg(F.count("*").alias("functions")), edges.agg(F.count("*").alias("edges"))]
    return kinds.withColumn("one", F.lit(1)).join(counts[0].withColumn("one", F.lit(1)), "one").join(counts[1].withColumn("one", F.lit(1)), "one").drop("one")


def in_order(nodes: DataFrame, units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes by id with the names in their arrays sorted, units (node, file, line) by node and place, edges by src and dst."""
    lists = {f.name: F.array_sort(f.name) for f in nodes.schema if f.dataType.typeName() == "array"}
    return nodes.withColumns(lists).orderBy("id"), units.orderBy("node", "file", "line"), edges.orderBy("src", "dst")
