"""Whole questions over Python sources: each reads files, parses them once and puts the operators together.

files: path, content, as `python_code.discover` gives them.  Results are DataFrames; a threshold gives
findings, and `exit_code` says whether there are any.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.functions import paths
from loupe.operators import coverage, crap as crap_, endpoints, examples, graph, imports, similarity, syntax, testshape
from loupe.operators.tables import cut
from loupe.sources import python_code

#: Similarity of near-duplicate functions (fixed value).
SIMILAR = 0.82


def _parsed(files: DataFrame, tests: bool | None = None) -> DataFrame:
    """nodes of files: of all, of test files, or of the others."""
    if tests is not None:
        mark = python_code.is_test(F.col("path"))
        files = files.where(mark if tests else ~mark)
    return cut(python_code.parse(files))


def _units(nodes: DataFrame) -> DataFrame:
    return syntax.complexity(syntax.units(nodes), nodes)


def _ids(rows: DataFrame) -> DataFrame:
    """rows with an id made of file and place, which is the same in every run."""
    return rows.withColumn("id", F.concat_ws("\0", "file", F.lpad(F.col("pre").cast("string"), 10, "0")))


def units(files: DataFrame) -> DataFrame:
    """(file, namespace, name, kind, private, start_line, end_line, complexity) of the functions of all files."""
    return _units(_parsed(files)).select("file", "namespace", "name", "kind", "private", "start_line", "end_line", "complexity").orderBy("file", "start_line", "name")


def crap(files: DataFrame, segments: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Functions of sources with complexity, coverage, crap and band, worst first.

    segments (of a report reader, with file as in files) are merged and met by lines from a function's body on.  A function without any
    measured line has no coverage if nothing is measured at all, else 0 where its file is in no report.
    With only (path), the functions of those files alone are returned, with the values that they have among all.
    """
    scored = _crap(_parsed(files, tests=False), segments)
    return scored if only is None else scored.join(only.select(F.col("path").alias("file")), "file", "left_semi").orderBy(F.col("crap").isNull(), F.col("crap").desc(), F.col("complexity").desc(), "file", "ord")


def _crap(nodes: DataFrame, segments: DataFrame | None) -> DataFrame:
    rows = _units(nodes).withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("pre")))
    if segments is None:
        rows = rows.withColumn("coverage", F.lit(None).cast("double"))
    else:
        merged = cut(coverage.merge_segments(segments))
        ranges = rows.select("file", F.col("ord").alias("id"), F.coalesce("body_line", "start_line").alias("low"), F.col("end_line").alias("high"))
        shares = coverage.range_share(ranges, merged).select("file", F.col("id").alias("ord"), F.col("share").alias("coverage"))
        loaded = merged.select("file").distinct().withColumn("loaded", F.lit(True))
        rows = rows.join(shares, ["file", "ord"], "left").join(loaded, "file", "left").withColumn("language", F.lit("python"))
        filled = crap_.unloaded_as_untested(rows)
        rows = filled.join(rows.select("file", "ord", F.col("coverage").alias("measured")), ["file", "ord"]).withColumn("coverage", F.when(F.col("loaded"), F.col("measured")).otherwise(F.col("coverage")))
    scored = crap_.score(rows).select("file", "ord", "namespace", "name", "start_line", "end_line", "complexity", "coverage", "crap", "band")
    return scored.orderBy(F.col("crap").isNull(), F.col("crap").desc(), F.col("complexity").desc(), "file", "ord")


class Duplicates(NamedTuple):
    """candidates: as of `dry`.  groups: a row for each member of a group of candidates that hang together.  counts: file, start_line and duplicates of each function that is large enough."""

    candidates: DataFrame
    groups: DataFrame
    counts: DataFrame


def dry(files: DataFrame, threshold: float = SIMILAR, lines: int = 4, nodes: int = 20) -> DataFrame:
    """Candidates (score, left and right place): functions as large as that whose syntax is that similar."""
    return duplicates(files, None, threshold, lines, nodes).candidates


def duplicates(files: DataFrame, only: DataFrame | None = None, threshold: float = SIMILAR, lines: int = 4, nodes: int = 20) -> Duplicates:
    """Near-duplicate functions of files as candidates, groups and counts; with only (path), those with a side in these files."""
    parsed = _parsed(files, tests=False)
    found = syntax.units(parsed)
    prints = syntax.fingerprints(found, parsed)
    rows = cut(_ids(similarity.large_enough(found.join(prints, ["file", "pre"]).withColumnRenamed("n_nodes", "nodes"), lines, nodes)))
    ids = None if only is None else rows.join(only.select(F.col("path").alias("file")), "file", "left_semi").select("id")
    pairs = cut(similarity.similar_pairs(rows.select("id", F.lit("python").alias("part"), F.col("prints").alias("tokens")), threshold, ids))
    candidates = similarity.candidates(pairs, rows)
    return Duplicates(candidates, similarity.group_members(pairs, rows), similarity.duplicate_counts(rows.select("file", "start_line"), candidates))


def scrap(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(examples with metrics, score and smells; a report a file with pressure and action) of test files."""
    parsed = _parsed(files, tests=True)
    details = cut(testshape.scored(examples.measured(examples.examples(parsed), parsed)))
    rows = _ids(details.select("file", "pre", "post", "lines", "decisions", "is_table"))
    prints = syntax.fingerprints(rows, parsed)
    sets = cut(rows.join(prints, ["file", "pre"]).select("id", F.col("file").alias("part"), F.col("prints").alias("tokens"), "file", "lines", "decisions", "is_table", F.col("n_nodes").alias("nodes")))
    clusters = testshape.clusters(sets)
    return details.drop("pre", "post"), testshape.file_reports(details, clusters)


def routes(files: DataFrame) -> DataFrame:
    """Edges between modules by HTTP: requests of sources met with the routes that sources serve."""
    calls, serves = endpoints.route_sides(cut(endpoints.endpoints(_parsed(files, tests=False))))
    return graph.http_edges(calls, serves)


def modules(files: DataFrame) -> DataFrame:
    """(module, file, functions, worst) of sources, for the module graph."""
    rows = _units(_parsed(files, tests=False))
    return rows.groupBy(paths.module_of(F.col("file")).alias("module"), "file").agg(F.count("*").alias("functions"), F.max("complexity").alias("worst"))


class Graph(NamedTuple):
    """nodes: id, kind, label, parent, files, serves, calls, external and metrics of what is below.  units: node, file, line, name, complexity, crap.  edges: src, dst, kind, count, via.  totals: one row."""

    nodes: DataFrame
    units: DataFrame
    edges: DataFrame
    totals: DataFrame


def module_graph(files: DataFrame, repository: str, segments: DataFrame | None = None) -> Graph:
    """The graph of a repository from its sources alone (paths from its root): modules in their folders, their functions, imports and requests, with metrics rolled up.

    Coverage comes from segments as in `crap`; without it no function has a CRAP score.  Mutation results aren't read here: their counts are NULL.
    """
    nodes = _parsed(files, tests=False)
    sources = cut(files.where(~python_code.is_test(F.col("path"))).select(F.col("path").alias("file"), paths.module_of(F.col("path")).alias("module")).distinct())
    found = cut(endpoints.endpoints(nodes))
    named = sources.select("file", "module", F.translate("module", "/", ".").alias("namespace"), F.col("file").rlike(r"(^|/)__init__\.[^./]+$").alias("is_package"), F.lit(False).alias("is_test"))
    wanted = syntax.imports(nodes).select("file", F.col("module").alias("target"), "name")
    resolved = cut(imports.resolve_python(wanted, named).join(sources.withColumnRenamed("module", "src"), "file"))
    route = F.trim(F.concat_ws(" ", "method", "path"))
    facts = sources.select("module", F.lit("files").alias("field"), F.col("file").alias("value"))
    facts = facts.union(found.select(paths.module_of(F.col("file")), "side", route)).union(resolved.where("external IS NOT NULL").select("src", F.lit("external"), "external"))
    inside = lambda c: F.concat(F.lit(repository + "/"), F.when(F.col(c) == "", "(root)").otherwise(F.col(c)))
    imported = resolved.where("module IS NOT NULL AND module <> src").groupBy(inside("src").alias("src"), inside("module").alias("dst")).agg(F.count("*").alias("count"))
    asked = graph.http_edges(*endpoints.route_sides(found)).select(inside("src").alias("src"), inside("dst").alias("dst"), F.lit("http").alias("kind"), "count", F.split("via", ", ").alias("via"))
    edges = cut(imported.select("src", "dst", F.lit("import").alias("kind"), "count", F.array().cast("array<string>").alias("via")).unionByName(asked))
    scored = _crap(nodes, segments).join(sources, "file")
    units_ = cut(scored.select(inside("module").alias("node"), "file", F.col("start_line").alias("line"), "namespace", "name", "complexity", "coverage", "crap", "band"))
    unknown = [F.lit(None).cast("bigint").alias(c) for c in ("killed", "survived", "uncovered", "stale", "duplicates")]
    metrics = graph.roll_up(units_.select(F.col("node").alias("path"), "crap", *unknown)).withColumnRenamed("node", "id").drop("module")
    all_ = cut(graph.module_nodes(facts, repository))
    ordered = graph.in_order(all_.join(metrics, "id", "left").withColumn("functions", F.coalesce("functions", F.lit(0).cast("bigint"))), units_, edges)
    return Graph(*ordered, graph.totals(all_, units_, edges))


def graph_view(made: Graph, container: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, arrows, sides) of one level of a graph; the container "" holds repositories."""
    boxes = cut(graph.level(made.nodes, made.units, container))
    arrows, sides = graph.view(made.edges, cut(graph.boxed(made.nodes, boxes)))
    return boxes, graph.mark_cycles(cut(arrows)), sides


def exit_code(findings: DataFrame) -> int:
    """1 if there is a finding, else 0."""
    return int(bool(findings.limit(1).count()))
