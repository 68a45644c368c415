"""Coverage: merging segments, joining them with ranges and lines, and matching report paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_segments(segments: DataFrame) -> DataFrame:
    """Segments merged by (file, is_branch, key): most covered, any run, all sources; place and total of the first by ord.

    Segments with an empty key stay as they are.
    """
    keyed = segments.where("key <> ''").groupBy("file", "is_branch", "key").agg(
        F.min(F.struct("ord", "start", "end", "total")).alias("first"), F.max("covered").alias("covered"), F.bool_or("ran").alias("ran"), F.bit_or("from_mask").alias("from_mask")
    )
    columns = ["file", "is_branch", "key", "ord", "start", "end", "total", "covered", "ran", "from_mask"]
    keyed = keyed.select("file", "is_branch", "key", "first.ord", "first.start", "first.end", "first.total", "covered", "ran", "from_mask")
    return keyed.unionByName(segments.where("key = ''").select(*columns))


#: Lines of a block.  Ranges and places meet by file and block, so a long file's product stays within its blocks.
BLOCK = 256


def _block(line: str) -> Column:
    return F.floor(F.col(line) / BLOCK)


def _blocks(first: str, last: str) -> Column:
    """A row for each block that a range of lines touches; none for a range without a first or last line, or that ends before it starts."""
    return F.explode(F.when(F.col(first) <= F.col(last), F.sequence(_block(first), _block(last))))


def range_share(ranges: DataFrame, segments: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """ranges (file, id, low, high) with the covered share of segments that start in them; NULL where none does.

    Branch segments decide where a range has any, lines elsewhere.  skip (file, id, skip_low, skip_high):
    inner ranges whose segments belong to another.  File and block of lines are the equi key; places are a residual.
    """
    own = segments.select("file", "is_branch", "start", "total", "covered", _block("start").alias("block"))
    inside = ranges.withColumn("block", _blocks("low", "high")).join(own, ["file", "block"]).where("start BETWEEN low AND high")
    if skip is not None:
        out = skip.select(F.col("file").alias("f"), F.col("id").alias("i"), "skip_low", "skip_high")
        inside = inside.join(out, (F.col("file") == F.col("f")) & (F.col("id") == F.col("i")) & F.col("start").between(F.col("skip_low"), F.col("skip_high")), "left_anti")
    sums = inside.groupBy("file", "id").agg(*(F.sum(F.when(c, F.col(v))).alias(f"{n}_{v}") for n, c in (("b", F.col("is_branch")), ("l", ~F.col("is_branch"))) for v in ("total", "covered")))
    share = F.when(F.col("b_total") > 0, F.col("b_covered") / F.col("b_total")).otherwise(F.when(F.col("l_total") > 0, F.col("l_covered") / F.col("l_total")))
    return ranges.join(sums.select("file", "id", share.alias("share")), ["file", "id"], "left")


def line_sources(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """lines (file, line) with `executed` and the sources (1 in process, 2 integration) of executed segments over them."""
    spans = segments.select("file", "start", "end", "ran", "from_mask", _blocks("start", "end").alias("block"))
    over = lines.withColumn("block", _block("line")).join(spans, ["file", "block"]).where("line BETWEEN start AND end")
    masks = over.groupBy("file", "line").agg(F.bool_or("ran").alias("executed"), F.bit_or(F.when(F.col("ran"), F.col("from_mask")).otherwise(0)).alias("mask"))
    return masks.select("file", "line", "executed", (F.col("mask").bitwiseAND(1) > 0).alias("in_process"), (F.col("mask").bitwiseAND(2) > 0).alias("integration"))


def site_line(sites: DataFrame, measured: DataFrame) -> DataFrame:
    """sites (file, id, line, statement) with measured_line: the nearest measured line at or above, not above the statement; else the line itself.

    An as-of join: both sides are sorted together by file and line, so a file costs its rows and not their product.
    """
    names = sites.columns
    marks = measured.select("file", "line").distinct().select("file", "line", F.lit(0).alias("later"), F.col("line").alias("at"))
    rows = sites.select("file", "line", F.lit(1).alias("later"), F.lit(None).cast(measured.schema["line"].dataType).alias("at"), F.struct(*names).alias("site"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    above = F.last("at", ignorenulls=True).over(Window.partitionBy("file").orderBy("line", "later").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("above", above).where("later = 1")
    return found.select("site.*", F.when(F.col("above") >= F.col("site.statement"), F.col("above")).otherwise(F.col("site.line")).alias("measured_line"))


def match_paths(reported: DataFrame, sources: DataFrame, base: str = "") -> DataFrame:
    """reported (path) with the source it means; NULL if that is none or not clear.

    It is the source at the path itself, taken from `base` unless it is absolute; else the one that the longest tail of
    the path names below base; else the one with the same file name that shares the longest tail of
    components, if just one does.  Both kinds of separators and file:// count alike.  Tails and file names are equi keys.
    """
    from loupe.functions.paths import clean_path, shared_tail

    left = reported.select("path").distinct().withColumn("clean", clean_path(F.col("path")))
    right = sources.select(F.col("path").alias("source")).distinct().withColumn("at", clean_path(F.col("source")))
    parts = F.split("clean", "/")
    under = lambda tail: clean_path(F.concat(F.lit(f"{base}/" if base else ""), tail))
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when((i == 1) & F.col("clean").startswith("/"), F.col("clean")).otherwise(under(F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
    named = left.select("path", F.posexplode(tails).alias("rank", "at")).join(right, "at").groupBy("path").agg(F.min(F.struct("rank", "source"))["source"].alias("named"))
    rest = left.join(named, "path", "left_anti").withColumn("name", F.element_at(parts, -1))
    pairs = rest.join(right.withColumn("name", F.element_at(F.split("at", "/"), -1)), "name").select("path", "source", shared_tail(F.col("clean"), F.col("at")).alias("tail"))
    best = pairs.groupBy("path", "tail").agg(F.count("*").alias("n"), F.min("source").alias("source")).groupBy("path").agg(F.max(F.struct("tail", "n", "source")).alias("top"))
    alone = best.where("top.n = 1").select("path", F.col("top.source").alias("alone"))
    return left.select("path").join(named, "path", "left").join(alone, "path", "left").select("path", F.coalesce("named", "alone").alias("source"))


def span_union(blocks: DataFrame) -> DataFrame:
    """Blocks (file, span, weight, covered) of several reports as one each: largest weight, covered if any is."""
    return blocks.groupBy("file", "span").agg(F.max("weight").alias("weight"), F.bool_or("covered").alias("covered"))


def line_inventory(segments: DataFrame) -> DataFrame:
    """Every line under a segment, and whether any that covers it was covered."""
    lines = segments.select("file", F.explode(F.sequence("start", "end")).alias("line"), (F.col("covered") > 0).alias("covered"))
    return lines.groupBy("file", "line").agg(F.bool_or("covered").alias("covered"))


def restrict_integration(integration: DataFrame, in_process: DataFrame) -> DataFrame:
    """Integration segments whose (file, kind, key) the in-process report has; those of files it doesn't know, and those without key, stay."""
    keys = in_process.select("file", "is_branch", "key").distinct()
    files = in_process.select("file").distinct()
    known = integration.join(files, "file", "left_semi").where("key <> ''").join(keys, ["file", "is_branch", "key"], "left_semi")
    return known.unionByName(integration.where("key = ''").join(files, "file", "left_semi")).unionByName(integration.join(files, "file", "left_anti"))
