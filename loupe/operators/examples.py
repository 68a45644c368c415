"""Test examples of Python code from the `nodes` relation: where they are, and what they assert, mock and decide.

Nodes meet intervals (pre to post) by file, so work is bounded by a file's own nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.operators import syntax
from loupe.operators.endpoints import callee
from loupe.operators.intervals import innermost, outside
from loupe.operators.tables import cut

#: Methods that set up or tear down, names of mocks, objects that mock, kinds whose bodies hold no examples, and names that assert.
SETUP = ("setUp", "tearDown", "setUpClass", "tearDownClass", "setup_method", "teardown_method", "setup_class", "teardown_class", "setup_function", "teardown_function")
MOCKS = ("patch", "MagicMock", "Mock", "AsyncMock", "create_autospec", "PropertyMock")
MOCKING = ("patch", "mocker", "monkeypatch")
BLOCKS = ("function_definition", "if_statement", "elif_clause", "for_statement", "while_statement", "with", "asyncwith", "try", "trystar", "except_clause", "match", "case_clause")
ASSERTIVE = r"^([aA]ssert|[eE]xpect|[cC]heck|[vV]erify|[mM]ust)($|_|\p{Lu})"


def _under(rows: DataFrame, spans: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """rows (file, pre) joined with each of the spans (file, low, high) that they lie in: for few spans, which may be many deep."""
    spans = spans.withColumnRenamed("file", "span_file")
    return rows.join(spans, (F.col("file") == F.col("span_file")) & F.col("pre").between(F.col(low), F.col(high))).drop("span_file")


def _spans(rows: DataFrame, own: bool = True) -> DataFrame:
    return rows.select("file", (F.col("pre") + (0 if own else 1)).alias("low"), F.col("post").alias("high"))


def _functions(nodes: DataFrame) -> DataFrame:
    """Functions at the top of a module or of classes in it, with their groups and what their decorators say."""
    top = outside(nodes.where("kind = 'function_definition'"), _spans(nodes.where(F.col("kind").isin(*BLOCKS)), own=False))
    boxes = _spans(nodes.where("kind = 'class_definition'"), own=False)
    named = nodes.where("kind = 'class_definition'").select(F.col("file"), (F.col("pre") + 1).alias("low"), F.col("text").alias("box"))
    inside = _under(top.select("file", "pre"), boxes).join(named, ["file", "low"])
    groups = inside.groupBy("file", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("low", "box"))), lambda x: x["box"]), " › ").alias("group"))
    marks = nodes.where("role = 'decorator_list'").groupBy("file", F.col("parent").alias("pre")).agg(F.min("start_line").alias("marked"), F.bool_or(F.col("text").contains("parametrize")).alias("is_table"), F.bool_or(F.col("text").contains("fixture")).alias("fixture"))
    rows = top.join(groups, ["file", "pre"], "left").join(marks, ["file", "pre"], "left")
    return rows.select(
        "file", "pre", "post", F.coalesce("group", F.lit("")).alias("group"), F.col("text").alias("name"), F.least("start_line", "marked").alias("start_line"), "end_line",
        F.coalesce("is_table", F.lit(False)).alias("is_table"), F.coalesce("fixture", F.lit(False)).alias("fixture"),
    )


def examples(nodes: DataFrame) -> DataFrame:
    """(file, ord, group, name, start_line, end_line, is_table, pre, post): functions named test…, with the classes around them as group; parametrised ones are tables."""
    rows = _functions(nodes).where(F.col("name").startswith("test")).drop("fixture")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("file").orderBy("pre")))


def setup_lines(nodes: DataFrame) -> DataFrame:
    """(file, setup_lines): lines of fixtures and of methods that set up or tear down; files without have no row."""
    rows = _functions(nodes).where(~F.col("name").startswith("test") & (F.col("fixture") | F.col("name").isin(*SETUP)))
    return rows.groupBy("file").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("setup_lines"))


def _asserting(object_: Column, name: Column) -> Column:
    return name.rlike(ASSERTIVE) | ((object_ == "pytest") & name.isin("raises", "warns"))


def _named_calls(nodes: DataFrame) -> DataFrame:
    """nodes with object and name of calls, and whether they assert by themselves."""
    object_, name = callee(F.coalesce("text", F.lit("")))
    rows = nodes.withColumn("object", F.when(F.col("kind") == "call", object_)).withColumn("called", F.when(F.col("kind") == "call", name))
    return rows.withColumn("asserts", (F.col("kind") == "assert_statement") | F.coalesce(_asserting(F.col("object"), F.col("called")), F.lit(False)))


def helpers(nodes: DataFrame) -> DataFrame:
    """(file, called): functions that assert, or call by its bare name one that does.

    Functions are read twice in their order: a round finds those that call helpers of the rounds before, or ones
    that the same round has found further up.  So a chain of helpers in order is found at once, and one that
    runs against the order as far as two steps.
    """
    rows = _named_calls(nodes)
    units = syntax.units(nodes).select("file", "ord", F.regexp_replace("name", r"#\d+$", "").alias("unit"), "pre", "post")
    spans = units.select("file", "ord", "unit", (F.col("pre") + 1).alias("low"), F.col("post").alias("high"))
    inside = innermost(rows.where("asserts OR (kind = 'call' AND object = '')").select("file", "pre", "called", "asserts"), spans)
    facts = cut(inside.groupBy("file", "ord", "unit", "called").agg(F.bool_or("asserts").alias("asserts")))
    calls = facts.where("NOT asserts").select("file", "ord", "unit", F.col("called").alias("helper"))
    first = facts.where("asserts").groupBy("file", F.col("unit").alias("called")).agg(F.lit(0).alias("round"), F.min("ord").alias("at"))
    found, n = cut(first), -1
    while n != (n := found.agg(F.count("*"), F.sum("round"), F.sum("at")).first()):
        # a helper found in round r at place p is known to later places in round r, and to all in round r + 1
        via = calls.join(found.withColumnRenamed("called", "helper"), ["file", "helper"])
        later = via.select("file", F.col("unit").alias("called"), F.when(F.col("ord") > F.col("at"), F.col("round")).otherwise(F.col("round") + 1).alias("round"), F.col("ord").alias("at")).where("round < 2")
        found = cut(found.unionByName(later).groupBy("file", "called").agg(F.min(F.struct("round", "at")).alias("first")).select("file", "called", "first.*"))
    return found.select("file", "called")


def measured(examples_: DataFrame, nodes: DataFrame) -> DataFrame:
    """examples with raw_lines, lines (less lines of multi-line literals and of case tables), decisions, mocks, assertions and is_table.

    An assertion counts once and isn't looked into.  An `if` whose whole body asserts is a guard: its assertions count, its condition
    doesn't.  A loop over cases whose body asserts makes a table and is no decision; the cases that it loops over are data.
    """
    known = helpers(nodes).withColumn("helps", F.lit(True))
    rows = _named_calls(nodes).join(known, ["file", "called"], "left").withColumn("asserts", F.col("asserts") | (F.coalesce("helps", F.lit(False)) & (F.col("object") == ""))).drop("helps")
    spans = examples_.select("file", F.col("pre").alias("low"), F.col("post").alias("high"), F.col("ord").alias("example"))
    inside = cut(innermost(rows, spans).drop("low", "high"))
    asserts = inside.where("asserts")

    stated = inside.where("kind = 'expr'").join(asserts.select("file", F.col("parent").alias("pre")).distinct().withColumn("good", F.lit(True)), ["file", "pre"], "left_outer")
    good = stated.where("good").select("file", "pre", F.lit(True).alias("good"))
    kids = inside.where("role IN ('body', 'orelse', 'test')").join(good, ["file", "pre"], "left").groupBy("file", F.col("parent").alias("pre")).agg(
        F.bool_and((F.col("role") == "test") | ((F.col("role") == "body") & F.coalesce("good", F.lit(False)))).alias("guard"), F.min(F.when(F.col("role") == "test", F.struct("pre", "post"))).alias("test")
    )
    guards = inside.where("kind = 'if_statement'").join(kids, ["file", "pre"]).where("guard")

    hidden = _spans(asserts, own=False).unionByName(guards.select("file", F.col("test.pre").alias("low"), F.col("test.post").alias("high")))
    seen = outside(asserts, hidden).groupBy("file", F.col("example").alias("ord")).agg(F.count("*").alias("assertions"))
    rest = outside(inside.where(~F.col("asserts")), _spans(asserts).unionByName(_spans(guards)))

    running = inside.where("asserts OR called = 'Run'").select("file", "pre")
    loops = inside.where("kind = 'for_statement'").select("file", F.col("pre").alias("loop"), (F.col("pre") + 1).alias("low"), F.col("post").alias("high"))
    tables = _under(running, loops).select("file", F.col("loop").alias("pre")).distinct().withColumn("over_cases", F.lit(True))
    marked = rest.join(tables, ["file", "pre"], "left").withColumn("over_cases", F.coalesce("over_cases", F.lit(False)))
    mocks = (F.col("kind") == "call") & (F.col("called").isin(*MOCKS) | F.col("object").isin(*MOCKING))
    decides = F.col("kind").isin(*syntax.DECISIONS["python"]) & ~F.col("over_cases")
    counts = marked.groupBy("file", F.col("example").alias("ord")).agg(F.count_if(mocks).alias("mocks"), F.count_if(decides).alias("decisions"), F.bool_or("over_cases").alias("loops"))

    iterated = inside.where("role = 'iter'").join(marked.where("over_cases").select("file", F.col("pre").alias("parent")), ["file", "parent"], "left_semi")
    target = inside.where("kind = 'identifier' AND role IN ('targets', 'target')").select("file", "example", "parent", F.col("text"))
    assigned = inside.where("kind IN ('assign', 'annassign')").select("file", F.col("pre").alias("parent"))
    value = inside.where("role = 'value'").join(assigned, ["file", "parent"], "left_semi").select("file", "parent", F.col("pre").alias("value_pre"))
    bound = target.join(value, ["file", "parent"]).groupBy("file", "example", "text").agg(F.min("value_pre").alias("pre"))
    cases = iterated.where("kind <> 'identifier'").select("file", "pre").unionByName(iterated.where("kind = 'identifier'").drop("pre").join(bound, ["file", "example", "text"]).select("file", "pre"))
    marks = inside.where("role = 'decorator_list' AND contains(text, 'parametrize')").select("file", "pre")
    data = inside.join(cases.unionByName(marks).distinct().withColumn("is_data", F.lit(True)), ["file", "pre"], "left").where("(is_data OR kind IN ('literal', 'joinedstr')) AND end_line > start_line")
    outer = outside(data, _spans(data, own=False)).groupBy("file", F.col("example").alias("ord")).agg(F.sum(F.col("end_line") - F.col("start_line")).alias("data_lines"))

    both = examples_.join(seen, ["file", "ord"], "left").join(counts, ["file", "ord"], "left").join(outer, ["file", "ord"], "left")
    raw = F.col("end_line") - F.col("start_line") + 1
    number = [F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("decisions", "mocks", "assertions")]
    lines = (raw - F.coalesce("data_lines", F.lit(0))).cast("int").alias("lines")
    return both.select("file", "ord", "group", "name", "start_line", "end_line", raw.alias("raw_lines"), lines, *number, (F.col("is_table") | F.coalesce("loops", F.lit(False))).alias("is_table"), "pre", "post")
