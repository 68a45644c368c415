"""Functions, complexity, fingerprints, imports and mutation sites from the `nodes` relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loupe.operators.intervals import innermost, outside

#: Rules by language, as data (fixed values): kinds that decide, kinds of units and containers, token replacements by parent kind.
DECISIONS = {"python": ("if_statement", "elif_clause", "for_statement", "while_statement", "except_clause", "case_clause", "conditional_expression", "boolean_operator", "for_in_clause", "if_clause")}
UNITS = {"python": ("function_definition",)}
CONTAINERS = {"python": ("class_definition",)}
FLIPS = {"python": {"True": "False", "False": "True", "0": "1", "1": "0", "and": "or", "or": "and"}}

STATEMENTS = {"python": (
    "assert_statement", "assign", "annassign", "augassign", "break", "class_definition", "continue", "delete", "expr", "for_statement", "function_definition", "global", "if_statement", "import",
    "importfrom", "match", "nonlocal", "pass", "raise", "return", "try", "trystar", "typealias", "while_statement", "with", "asyncwith",
)}


def _of(kinds: dict[str, tuple[str, ...]], language: str):
    return F.col("kind").isin(*kinds[language])


def _spans(rows: DataFrame, *columns) -> DataFrame:
    """(file, low, high, ...) of subtrees."""
    return rows.select("file", F.col("pre").alias("low"), F.col("post").alias("high"), *columns)


def units(nodes: DataFrame, language: str = "python") -> DataFrame:
    """(file, ord, namespace, name, kind, private, start_line, end_line, body_line, pre, post): unit nodes with no unit above them, named by the containers around them; repeats are name#2, name#3."""
    every = nodes.where(_of(UNITS, language))
    top = outside(every, _spans(every), own=False)
    box = nodes.where(_of(CONTAINERS, language)).select(F.col("file").alias("f"), F.col("pre").alias("a"), F.col("post").alias("b"), F.col("text").alias("box"))
    inside = top.join(box, (F.col("file") == F.col("f")) & (F.col("a") < F.col("pre")) & (F.col("post") <= F.col("b")))
    spaces = inside.groupBy("file", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "box"))), lambda x: x["box"]), ".").alias("namespace"))
    named = top.join(spaces, ["file", "pre"], "left").withColumn("namespace", F.coalesce("namespace", F.lit("")))
    nth = F.row_number().over(Window.partitionBy("file", "namespace", "text").orderBy("pre"))
    private = F.col("text").startswith("_") & ~F.col("text").endswith("__")
    return named.withColumn("nth", nth).select(
        "file", F.row_number().over(Window.partitionBy("file").orderBy("pre")).alias("ord"), "namespace", F.when(F.col("nth") == 1, F.col("text")).otherwise(F.concat_ws("#", "text", "nth")).alias("name"),
        F.when(F.col("namespace") == "", "function").otherwise("method").alias("kind"), private.alias("private"), "start_line", "end_line", "body_line", "pre", "post",
    )


def complexity(units_: DataFrame, nodes: DataFrame, language: str = "python") -> DataFrame:
    """units with complexity: 1 and one for each deciding node below them."""
    deciding = nodes.where(_of(DECISIONS, language)).select("file", "pre")
    counts = innermost(deciding, _spans(units_), own=False).groupBy("file", F.col("low").alias("pre")).agg(F.count("*").alias("n"))
    return units_.join(counts, ["file", "pre"], "left").withColumn("complexity", (1 + F.coalesce("n", F.lit(0))).cast("int")).drop("n")


def labels(nodes: DataFrame) -> DataFrame:
    """nodes with the label that similarity looks at: literals and names are alike, called names count."""
    called = F.col("kind") == "call"
    return nodes.withColumn("label", F.when(F.col("kind") == "literal", "lit").when(F.col("kind") == "identifier", "id").when(called, F.concat(F.lit("call:"), F.coalesce(F.element_at(F.split("text", r"\."), -1), F.lit("")))).when(F.col("kind") == "operator", F.col("text")).otherwise(F.col("kind")))


def fingerprints(units_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, pre, prints, n_nodes): hashes of each node of a unit with its children, and with its grandchildren.

    Two bottom-up passes over parent links; child hashes keep their order.
    """
    level = labels(nodes).select("file", F.col("pre").alias("at"), "parent", "label", F.xxhash64("label").alias("h0"))

    def above(rows: DataFrame, h: str, name: str) -> DataFrame:
        kids = rows.where("parent IS NOT NULL").groupBy("file", "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", h))), lambda x: x[h]).alias("kids")).withColumnRenamed("parent", "at")
        return rows.join(kids, ["file", "at"], "left").withColumn(name, F.xxhash64("label", F.coalesce("kids", F.array().cast("array<bigint>")), F.lit(name))).drop("kids")

    both = above(above(level, "h0", "h1"), "h1", "h2").select("file", "at", "h1", "h2")
    inside = innermost(both, _spans(units_), at="at").withColumnRenamed("low", "pre")
    return inside.groupBy("file", "pre").agg(F.array_sort(F.collect_set("h1")).alias("one"), F.array_sort(F.collect_set("h2")).alias("two"), F.count("*").alias("n_nodes")).select("file", "pre", F.array_sort(F.array_union("one", "two")).alias("prints"), "n_nodes")


def unit_hash(units_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, pre, hash): 16 hex digits of the SHA-256 of a unit's nodes; comments and layout don't count."""
    text = nodes.select("file", F.col("pre").alias("at"), F.concat_ws("\0", "kind", F.coalesce("text", F.lit("")), (F.col("post") - F.col("pre")).cast("string")).alias("part"))
    inside = innermost(text, _spans(units_), at="at").withColumnRenamed("low", "pre")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\1")
    return inside.groupBy("file", "pre").agg(F.substring(F.sha2(joined, 256), 1, 16).alias("hash"))


def imports(nodes: DataFrame) -> DataFrame:
    """(file, line, module, name): what a file imports; relative modules keep their dots."""
    rows = nodes.where(F.col("kind").isin("import", "importfrom")).select("file", F.col("start_line").alias("line"), "kind", F.explode(F.split("text", ",")).alias("item"))
    return rows.select("file", "line", F.when(F.col("kind") == "import", F.col("item")).otherwise(F.regexp_extract("item", "^(.*):", 1)).alias("module"), F.when(F.col("kind") == "importfrom", F.regexp_extract("item", ":([^:]*)$", 1)).alias("name"))


def statement_lines(nodes: DataFrame, language: str = "python") -> DataFrame:
    """nodes with statement_line, where the innermost statement that holds a node starts, the node itself included; its own line where none does."""
    held = _spans(nodes.where(_of(STATEMENTS, language)), F.col("start_line").alias("first"))
    return innermost(nodes, held, outer=True).withColumn("statement_line", F.coalesce("first", "start_line")).drop("first", "low", "high")


def own_nodes(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """nodes with the unit whose own code they are: of all units (file, unit, pre, post), inline ones included, the innermost that holds the node.

    So a unit's own nodes are its span less the spans of inline units in it; nodes in no unit are left out.
    """
    return innermost(nodes, _spans(spans, "unit")).drop("low", "high")


def own_complexity(nodes: DataFrame, spans: DataFrame, language: str = "python") -> DataFrame:
    """spans (file, unit, pre, post) with complexity: 1 and one for each deciding node of a unit's own code, itself not counted."""
    deciding = innermost(nodes.where(_of(DECISIONS, language)).select("file", "pre"), _spans(spans, "unit"), own=False)
    counts = deciding.groupBy("file", "unit").agg((1 + F.count("*")).cast("int").alias("complexity"))
    return spans.join(counts, ["file", "unit"], "left").withColumn("complexity", F.coalesce("complexity", F.lit(1)))


def mutation_sites(units_: DataFrame, nodes: DataFrame, language: str = "python") -> DataFrame:
    """(file, unit, line, original, replacement): literals and connectives of units that a mutant would flip."""
    flips = F.create_map(*(F.lit(x) for pair in FLIPS[language].items() for x in pair))
    rows = nodes.where(F.col("kind").isin("literal", "boolean_operator")).select("file", F.col("pre").alias("at"), F.col("start_line").alias("line"), F.col("text").alias("original"), flips[F.col("text")].alias("replacement")).where("replacement IS NOT NULL")
    inside = innermost(rows, _spans(units_, "namespace", "name"), at="at")
    return inside.select("file", F.concat_ws(".", F.expr("nullif(namespace, '')"), "name").alias("unit"), "line", "at", "original", "replacement").orderBy("file", "line", "at")
