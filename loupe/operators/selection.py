"""Choosing files and functions: fragments, globs, changed ranges and packed text findings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions.paths import matches_any


def select_fragments(paths: DataFrame, fragments: list[str]) -> DataFrame:
    """paths (path) that contain a fragment, with the first one in argument order that they contain."""
    first = F
    for fragment in fragments:
        first = first.when(F.col("path").contains(fragment), fragment)
    return paths.withColumn("fragment", first).where("fragment IS NOT NULL") if fragments else paths.withColumn("fragment", F.lit(None).cast("string")).limit(0)


def unmatched_fragments(paths: DataFrame, fragments: list[str]) -> list[str]:
    """Fragments that no path contains; one pass for all."""
    if not fragments:
        return []
    hits = paths.agg(*(F.coalesce(F.bool_or(F.col("path").contains(f)), F.lit(False)).alias(str(i)) for i, f in enumerate(fragments))).first()
    return [f for i, f in enumerate(fragments) if not hits[str(i)]]


def exclude(paths: DataFrame, globs: list[str]) -> DataFrame:
    """paths with `excluded`: whether a glob matches a source; tests are never excluded (role, where given)."""
    hit = matches_any(F.col("path"), globs)
    return paths.withColumn("excluded", hit & (F.col("role") != "test") if "role" in paths.columns else hit)


def touched(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """units (file, start_line, end_line) that a changed range (file, start, end) overlaps."""
    changed = ranges.select(F.col("file").alias("f"), F.col("start").alias("low"), F.col("end").alias("high"))
    return units.join(changed, (F.col("file") == F.col("f")) & (F.col("low") <= F.col("end_line")) & (F.col("high") >= F.col("start_line")), "left_semi")


def changed_functions(units: DataFrame, ranges: DataFrame, base: DataFrame) -> DataFrame:
    """Touched units whose (id, hash) the base doesn't have."""
    return touched(units, ranges).join(base.select("id", "hash").distinct(), ["id", "hash"], "left_anti")


def build_roots(files: DataFrame, gaps: DataFrame) -> DataFrame:
    """files (file, language) with a gap (dir, language) at or above them."""
    from loupe.functions.paths import ancestors

    steps = files.select("file", "language", F.explode(ancestors(F.col("file"))).alias("dir"))
    return steps.join(gaps.select("dir", "language").distinct(), ["dir", "language"]).select("file", "language").distinct()


def renew_exceptions(stale: DataFrame, sites: DataFrame) -> DataFrame:
    """Where an exception (id, file, function, change, line_text, line, column) points now among sites (file, function, change, text, line, column).

    With line text: the sites whose text without blanks is equal, the one at its place first, alone
    otherwise; without: the one at its place, else the only one.  state: renewed, ambiguous or gone.
    """
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    # sites are summed by text and place, and once more under no text, so that no exception meets each site of its change
    change, place = ["file", "function", "change"], ["at_line", "at_column"]
    known = sites.where("line IS NOT NULL").select(*change, F.explode(F.array(F.lit("-"), F.concat(F.lit("="), bare(F.col("text"))))).alias("look"), F.col("line").alias("at_line"), F.col("column").alias("at_column")).where("look IS NOT NULL")
    spots = known.groupBy(*change, "look", *place).agg(F.count("*").alias("here"))
    spot = F.struct(F.col("at_line").alias("line"), F.col("at_column").alias("column"))
    texts = spots.groupBy(*change, "look").agg(F.sum("here").alias("n"), F.min(spot).alias("only"))
    asked = stale.select("id", *change, F.coalesce(F.concat(F.lit("="), bare(F.col("line_text"))), F.lit("-")).alias("look"), F.col("line").alias("at_line"), F.col("column").alias("at_column"))
    sums = asked.join(texts, [*change, "look"], "left").join(spots.withColumn("place", spot), [*change, "look", *place], "left")
    target = F.when(F.col("here") == 1, F.col("place")).when(F.col("n") == 1, F.col("only"))
    return sums.select("id", F.when(target.isNotNull(), "renewed").when(F.col("n") > 1, "ambiguous").otherwise("gone").alias("state"), target["line"].alias("line"), target["column"].alias("column"))


def union_in_order(*lists: DataFrame) -> DataFrame:
    """The paths (path) of sorted lists, each once: those of the first list, then what the next ones add."""
    marked = [rows.select("path", F.lit(i).alias("list")) for i, rows in enumerate(lists)]
    return functools.reduce(DataFrame.union, marked).groupBy("path").agg(F.min("list").alias("list")).orderBy("list", "path").select("path")


def block_lines(span: Column, line: Column) -> Column:
    """(first, last) line of a block "line.column,line.column", both included, without a last line that it ends before; without a span, its own line."""
    first, last = (F.regexp_extract(span, pattern, 1).try_cast("int") for pattern in (r"^([0-9]+)(?:\.[^,]*)?,", r"^[^,]*,([0-9]+)(?:\.|$)"))
    before = F.regexp_extract(span, r",[0-9]+\.(.*)$", 1) == "1"
    spans = F.struct(first.alias("first"), F.when(before & (last > first), last - 1).otherwise(last).alias("last"))
    return F.when(first.isNotNull() & last.isNotNull() & (last >= first), spans).otherwise(F.struct(line.alias("first"), line.alias("last")))


def judged_lines(blocks: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """blocks (file, span, line) that strict coverage judges: all without ranges, else those with a line in a changed range (file, start, end)."""
    if ranges is None:
        return blocks
    placed = blocks.withColumn("lines", block_lines(F.col("span"), F.col("line")))
    changed = ranges.select(F.col("file").alias("f"), F.col("start").alias("low"), F.col("end").alias("high"))
    return placed.join(changed, (F.col("file") == F.col("f")) & (F.col("low") <= F.col("lines.last")) & (F.col("high") >= F.col("lines.first")), "left_semi").drop("lines")
