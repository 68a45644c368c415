"""Coverage evidence of functions: the measured lines or blocks that are a function's own, and whether they are all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.operators.intervals import innermost


def _blocks() -> Column:
    """The blocks of a function, by line, column and span."""
    held = F.when(F.col("line").isNotNull(), F.struct("line", "column", "span", "weight", "covered"))
    return F.transform(F.array_sort(F.collect_list(held)), lambda x: F.struct(x["span"].alias("span"), x["line"].alias("line"), x["column"].alias("column"), x["weight"].alias("weight"), x["covered"].alias("covered")))


def line_evidence(units: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """units (file, unit, language, start_line, body_line, end_line) with blocks and complete.

    lines: file, line, covered.  files: file, proven (whether its report lists every executable line).  A function's lines run from
    its body (its start where that is unknown) to its end, without those of functions inside it from the line after their
    start on.  In Kotlin body_line is the first statement's; a function without one has nothing to prove, so its
    evidence is complete.  In a file that isn't proven there are no blocks, and the evidence isn't complete.
    """
    known, own = _own_lines(units, lines, files)
    own = own.select("file", "unit", "line", F.lit(None).cast("int").alias("column"), F.col("line").cast("string").alias("span"), F.lit(1).alias("weight"), "covered")
    counted = own.groupBy("file", "unit").agg(_blocks().alias("blocks"))
    return known.join(counted, ["file", "unit"], "left").select(*units.columns, F.coalesce("blocks", F.array().cast(counted.schema["blocks"].dataType)).alias("blocks"), (F.col("proven") | F.col("bare")).alias("complete"))


def line_sums(units: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """units with complete and what `line_evidence` comes to: n_blocks, n_covered and places (the sum of their lines).

    Lines are summed as rows, so a function may have any number of them; blocks in a cell are one task's.
    """
    known, own = _own_lines(units, lines, files)
    counted = own.groupBy("file", "unit").agg(F.count("*").alias("n_blocks"), F.count_if("covered").alias("n_covered"), F.sum("line").cast("bigint").alias("places"))
    sums = (F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_blocks", "n_covered", "places"))
    return known.join(counted, ["file", "unit"], "left").select(*units.columns, (F.col("proven") | F.col("bare")).alias("complete"), *sums)


def _own_lines(units: DataFrame, lines: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """units with proven and bare, and the lines (file, unit, line, covered) that are theirs, of those that are proven and not bare."""
    bare = (F.col("language") == "kotlin") & F.col("body_line").isNull()
    first = F.when(F.coalesce("body_line", F.lit(0)) > 0, F.col("body_line")).otherwise(F.col("start_line"))
    known = units.join(files.where("proven").select("file").distinct().withColumn("proven", F.lit(True)), "file", "left")
    known = known.select(*units.columns, F.coalesce("proven", F.lit(False)).alias("proven"), bare.alias("bare"), first.alias("first"), F.greatest(first, F.col("start_line") + 1).alias("taken"))
    # what a unit takes from those around it begins after its start; a body on the start line is the unit's own as well
    spans = known.select("file", F.col("taken").alias("low"), F.col("end_line").alias("high"), "unit", "first")
    inside = innermost(lines, spans, at="line").where("line >= first").select("file", "unit", "line", "covered")
    start = lines.join(known.where("first < taken").select("file", "unit", F.col("first").alias("line")), ["file", "line"]).select("file", "unit", "line", "covered")
    return known, known.where("proven AND NOT bare").select("file", "unit").join(inside.unionByName(start), ["file", "unit"])


def block_evidence(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """units (file, unit, start_line, start_column, end_line, end_column, runs) with blocks and complete, from a report of blocks.

    blocks: file, span, line, column, weight, covered.  A block belongs to the unit that it begins in, the end not included; blocks of
    weight 0 don't count.  complete: there are blocks, or the unit runs no statement (runs false).
    """
    spot = lambda line, column: F.col(line).cast("bigint") * (1 << 32) + F.col(column)
    spans = units.select("file", spot("start_line", "start_column").alias("low"), (spot("end_line", "end_column") - 1).alias("high"), "unit")
    own = innermost(blocks.where("weight > 0").withColumn("spot", spot("line", "column")), spans, at="spot")
    counted = own.groupBy("file", "unit").agg(_blocks().alias("blocks"))
    return units.join(counted, ["file", "unit"], "left").select(*units.columns, F.coalesce("blocks", F.array().cast(counted.schema["blocks"].dataType)).alias("blocks"), (F.col("blocks").isNotNull() | ~F.col("runs")).alias("complete"))
