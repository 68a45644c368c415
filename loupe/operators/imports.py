"""Resolving imports of each language to modules, and what tests reach.

files: file, module, namespace, is_package, is_test.  imports: file, target (as written, relative ones
with their dots), name (imported from it, NULL for the whole).  Results: file, target, name, module
(NULL if external or unknown), external (its top name, NULL otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions.paths import ancestors
from loupe.operators import graph


def _dotted_steps(name: Column, separator: str = ".") -> Column:
    """A dotted name and what is above it, longest first."""
    parts = F.split(name, rf"\{separator}")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def _ladder(wanted: DataFrame, key: list[str], steps: str, index: DataFrame) -> DataFrame:
    """The module of the first step that the index (name, module) has, for each key."""
    tried = wanted.select(*key, F.posexplode(steps).alias("rung", "step"))
    return tried.join(index.withColumnRenamed("name", "step"), "step").groupBy(*key).agg(F.min_by("module", "rung").alias("module"))


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports climb a package for each dot; a name that is a module counts, else the nearest package that is there; tests also look beside themselves; the rest is external."""
    index = files.groupBy(F.col("namespace").alias("name")).agg(F.max_by("module", "file").alias("module"))
    rows = imports.withColumn("nth", F.monotonically_increasing_id()).join(files.select("file", "namespace", "is_package", "is_test"), "file")
    home = F.filter(F.split("namespace", r"\."), lambda x: x != "")
    package = F.when(F.col("is_package"), home).otherwise(F.slice(home, 1, F.greatest(F.size(home) - 1, F.lit(0))))
    dots, rest = F.length(F.regexp_extract("target", r"^(\.*)", 1)), F.regexp_replace("target", r"^\.+", "")
    rows = rows.withColumn("package", package).withColumn("dots", dots).withColumn("rest", rest)
    kept = F.slice("package", 1, F.greatest(F.size("package") - F.col("dots") + 1, F.lit(0)))
    absolute = F.array_join(F.concat(kept, F.when(F.col("rest") == "", F.array().cast("array<string>")).otherwise(F.array("rest"))), ".")
    rows = rows.where("dots = 0 OR dots - 1 <= size(package)").withColumn("full", F.when(F.col("dots") > 0, absolute).otherwise(F.col("rest")))
    beside = F.when((F.col("dots") == 0) & F.col("is_test") & (F.size("package") > 0), F.concat(F.array_join("package", "."), F.lit("."), F.col("full")))

    def steps(base: Column) -> Column:
        named = F.when(F.col("name").isNotNull(), F.array(F.concat_ws(".", F.when(base != "", base), "name"))).otherwise(F.array().cast("array<string>"))
        return F.when(base.isNotNull(), F.concat(named, _dotted_steps(base))).otherwise(F.array().cast("array<string>"))

    rows = rows.withColumn("steps", F.concat(steps(F.col("full")), steps(beside)))
    found = _ladder(rows, ["nth"], "steps", index)
    out = rows.join(found, "nth", "left")
    return out.select("file", "target", "name", "module", F.when(F.col("module").isNull() & (F.col("dots") == 0), F.element_at(F.split("full", r"\."), 1)).alias("external"))


def resolve_paths(imports: DataFrame, files: DataFrame, aliases: DataFrame | None = None, extensions: tuple[str, ...] = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")) -> DataFrame:
    """TypeScript: relative files or their index, then aliases (prefix, target, rank; longest prefix first), else external, scoped names with two parts."""
    bare = lambda c: F.regexp_replace(c, "(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$", "")
    index = files.select(bare(F.col("file")).alias("name"), "module").distinct()
    rows = imports.withColumn("nth", F.monotonically_increasing_id())
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    relative = F.col("target").startswith(".")
    # a/b/../c -> a/c: parts are pushed, and popped for each ..
    parts = F.split(F.concat_ws("/", F.when(folder != "", folder), "target"), "/")
    climbed = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(p.isin(".", ""), a).otherwise(F.concat(a, F.array(p))))
    place = bare(F.array_join(climbed, "/"))
    tried = rows.where(relative).select("nth", F.posexplode(F.array(place, F.concat(place, F.lit("/index")))).alias("order", "name"))
    if aliases is not None:
        hit = rows.where(~relative).join(aliases, rows["target"].startswith(aliases["prefix"]))
        to = bare(F.concat("alias_target", F.expr("substring(target, length(prefix) + 1)")))
        hit = hit.withColumnRenamed("alias", "alias_target").select("nth", (F.lit(1000) - F.length("prefix")).alias("near"), "rank", to.alias("to"))
        both = hit.select("nth", F.posexplode(F.array("to", F.concat("to", F.lit("/index")))).alias("i", "name"), "near", "rank")
        tried = tried.unionByName(both.select("nth", (F.col("near") * 10_000 + F.col("rank") * 2 + F.col("i")).cast("int").alias("order"), "name"))
    found = tried.join(index, "name").groupBy("nth").agg(F.min_by("module", "order").alias("module"))
    names = F.split("target", "/")
    top = F.when(F.col("target").startswith("@") & (F.size(names) > 1), F.concat_ws("/", names[0], names[1])).otherwise(names[0])
    return rows.join(found, "nth", "left").select("file", "target", F.lit(None).cast("string").alias("name"), "module", F.when(F.col("module").isNull() & ~relative, top).alias("external"))


def resolve_kotlin(imports: DataFrame, names: DataFrame) -> DataFrame:
    """names (name, module, package): a wildcard imports every module of its package, a full name the nearest name above it that is declared."""
    index = names.groupBy("name").agg(F.max("module").alias("module"))
    wild = imports.where(F.col("target").endswith(".*")).join(names.select(F.concat("package", F.lit(".*")).alias("target"), "module").distinct(), "target", "left")
    full = imports.where(~F.col("target").endswith(".*")).withColumn("nth", F.monotonically_increasing_id()).withColumn("steps", _dotted_steps(F.col("target")))
    found = full.join(_ladder(full, ["nth"], "steps", index), "nth", "left")
    out = wild.select("file", "target", "module").unionByName(found.select("file", "target", "module"))
    return out.select("file", "target", F.lit(None).cast("string").alias("name"), "module", F.when(F.col("module").isNull(), F.element_at(F.split("target", r"\."), 1)).alias("external"))


def resolve_dart(imports: DataFrame, files: DataFrame) -> DataFrame:
    """`package:name/path` finds lib/path of the package; other schemes are external; the rest is relative to the file.  files: file, module, package."""
    rows = imports.withColumn("scheme", F.regexp_extract("target", r"^([a-z]+):", 1))
    own = files.withColumn("target", F.concat(F.lit("package:"), "package", F.lit("/"), F.regexp_replace("file", r"^(.*/)?lib/", ""))).where(F.col("file").rlike(r"(^|/)lib/")).select("target", F.col("module").alias("found"))
    packaged = rows.where("scheme = 'package'").join(own.groupBy("target").agg(F.max("found").alias("module")), "target", "left")
    relative = resolve_paths(rows.where("scheme = ''").withColumn("target", F.when(F.col("target").startswith("."), F.col("target")).otherwise(F.concat(F.lit("./"), "target"))).select("file", "target"), files, extensions=(".dart",))
    outside = rows.where("scheme NOT IN ('', 'package')").withColumn("module", F.lit(None).cast("string"))
    top = F.when(F.col("module").isNull(), F.regexp_extract("target", r"^((?:package:)?[^/]*)", 1))
    both = packaged.select("file", "target", "module").unionByName(outside.select("file", "target", "module")).withColumn("external", top)
    return both.unionByName(relative.select("file", "target", "module", "external"))


def tests_reaching(tests: DataFrame, edges: DataFrame, support: DataFrame | None = None, one_hop: bool = False) -> DataFrame:
    """(test, module): modules that each test (test, module) reaches over import edges (src, dst); support files (dir, module) count for the tests below their folder.

    With one_hop only the test's own module and what it imports itself.
    """
    start = tests.select("test", "module")
    if support is not None:
        below = tests.select("test", F.explode(ancestors(F.col("test"))).alias("dir")).join(support, "dir")
        start = start.unionByName(below.select("test", "module")).distinct()
    reached = graph.reach(start.select("module").distinct(), edges, 1 if one_hop else None)
    return start.join(reached, start["module"] == reached["start"]).select("test", F.col("node").alias("module")).distinct()


def plan_groups(sources: DataFrame, reaching: DataFrame) -> DataFrame:
    """(language, root, tests, sources, unreached): sources (source, language, root) that the same tests reach, grouped; what no test reaches is a group of its own."""
    tests = reaching.groupBy("source").agg(F.array_sort(F.collect_set("test")).alias("tests"))
    rows = sources.join(tests, "source", "left").withColumn("tests", F.coalesce("tests", F.array().cast("array<string>")))
    return rows.groupBy("language", "root", "tests").agg(F.array_sort(F.collect_set("source")).alias("sources")).withColumn("unreached", F.size("tests") == 0)
