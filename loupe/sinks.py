"""Text forms of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def crap_table(scored: DataFrame) -> DataFrame:
    """A line for each function: CRAP, complexity, coverage and place; N/A without coverage."""
    share = F.when(F.col("coverage").isNull(), "N/A").otherwise(F.format_string("%.0f%%", F.col("coverage") * 100))
    value = F.when(F.col("crap").isNull(), "N/A").otherwise(F.format_string("%.1f", "crap"))
    return scored.select(F.format_string("%8s  %4d  %5s  %s", value, "complexity", share, "name").alias("line"))


def pair_table(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.format_string("%.2f  %s  %s", "score", F.col("a").cast("string"), F.col("b").cast("string")).alias("line"))


def report_table(reports: DataFrame) -> DataFrame:
    """A line for each test file, by pressure."""
    return reports.orderBy(F.col("pressure").desc(), "file").select(F.format_string("%7.1f  %-16s %s", "pressure", "action", "file").alias("line"))


def annotation(mutants: DataFrame) -> DataFrame:
    """(file, comment): totals of a file and its survivors in line order, for a comment above its code."""
    noticed = F.col("outcome").isin("killed", "timeout", "over-limit")
    totals = F.format_string("killed %d, survived %d, uncovered %d", F.count_if(noticed), F.count_if(F.col("outcome") == "survived"), F.count_if(F.col("outcome") == "uncovered"))
    left = F.array_sort(F.collect_list(F.when(F.col("outcome") == "survived", F.struct("line", F.format_string("%d: %s -> %s", "line", "original", "replacement").alias("text")))))
    return mutants.groupBy("file").agg(F.concat_ws("\n", totals, F.array_join(F.transform(left, lambda x: x["text"]), "\n")).alias("comment"))


def first_three(items: Column) -> Column:
    """The first three items, and how many more there are."""
    more = F.size(items) - 3
    return F.concat(F.array_join(F.slice(items, 1, 3), ", "), F.when(more > 0, F.concat(F.lit(" and "), more, F.lit(" more"))).otherwise(""))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names with -2, -3 after the first of equal ones."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("nth", nth).withColumn(name, F.when(F.col("nth") > 1, F.concat_ws("-", name, "nth")).otherwise(F.col(name))).drop("nth")


def test_command(template: str, ids: Column) -> Column:
    """A command with {ids} joined by blanks, {id} the first and {pattern} an alternation of them."""
    out = F.replace(F.lit(template), F.lit("{ids}"), F.array_join(ids, " "))
    out = F.replace(out, F.lit("{id}"), F.coalesce(F.get(ids, F.lit(0)), F.lit("")))
    return F.replace(out, F.lit("{pattern}"), F.array_join(ids, "|"))


def next_version(tags: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: the version after the newest tag (tag), by the largest change that a message (message) names."""
    part = lambda i: F.regexp_extract("tag", r"^v?(\d+)\.(\d+)\.(\d+)$", i).try_cast("int")
    newest = tags.agg(F.max(F.when(part(1).isNotNull(), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))).alias("v"))
    kind = F.when(F.col("message").rlike(r"^\w+(\([^)]*\))?!:|BREAKING CHANGE"), 3).when(F.col("message").rlike(r"^feat(\(|:)"), 2).when(F.col("message").rlike(r"^(fix|perf)(\(|:)"), 1).otherwise(0)
    bump = messages.agg(F.coalesce(F.max(kind), F.lit(0)).alias("bump"))
    v = lambda n: F.coalesce(F.col(f"v.{n}"), F.lit(0))
    one = newest.withColumn("k", F.lit(1)).join(bump.withColumn("k", F.lit(1)), "k")
    text = F.when(F.col("bump") == 3, F.concat_ws(".", v("major") + 1, F.lit(0), F.lit(0))).when(F.col("bump") == 2, F.concat_ws(".", v("major"), v("minor") + 1, F.lit(0))).when(F.col("bump") == 1, F.concat_ws(".", v("major"), v("minor"), v("patch") + 1))
    return one.select(text.alias("version"))


def one_line(text: Column) -> Column:
    """A text on one line: runs of white space are one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comment_name(name: Column, namespace: Column, file_namespace: Column, separator: str = ".") -> Column:
    """A function in its file's comment: Class#name with the class as the file's namespace leaves it; the bare name at the file's top."""
    above = F.concat(file_namespace, F.lit(separator))
    inner = F.when(F.startswith(namespace, above), F.substr(namespace, F.length(above) + 1)).otherwise(namespace)
    return F.when(namespace == file_namespace, name).otherwise(F.concat(inner, F.lit("#"), name))
