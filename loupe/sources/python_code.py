"""Python source files as a `nodes` relation: the one place where code is parsed.

Each file is parsed by the standard library in the task that reads it; everything after is DataFrame
operations over nodes (file, pre, post, parent, kind, text, start_line, end_line, body_line, role, value),
in which a subtree is the interval of pre-order numbers from pre to post.  role is the field by which the
parent holds a node; value is the text that a string expression gives, with {} for what isn't literal.  Kinds are named as in the
usual grammars, so tables of rules hold for other parsers too.  A file that doesn't parse gives one
node of kind `error`.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "file string, pre int, post int, parent int, kind string, text string, start_line int, end_line int, body_line int, role string, value string"
#: Grammar kinds of syntax classes whose name isn't simply their own in snake case (fixed values).
KINDS = {
    "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "If": "if_statement", "For": "for_statement", "AsyncFor": "for_statement",
    "While": "while_statement", "ExceptHandler": "except_clause", "match_case": "case_clause", "IfExp": "conditional_expression", "comprehension": "for_in_clause", "Call": "call",
    "Attribute": "attribute", "Name": "identifier", "Constant": "literal", "BinOp": "binary_operator", "UnaryOp": "unary_operator", "Compare": "comparison_operator", "Assert": "assert_statement",
}
#: Directories that hold no sources of a project (fixed values).
SKIPPED = ("node_modules", "__pycache__", "testdata", "venv", "vendor")


def discover(spark: SparkSession, roots: list[str], suffix: str = ".py") -> DataFrame:
    """(path, content) of the source files below roots, once each; hidden, cache and dependency folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(roots)
    parts = F.slice(F.split("path", "/"), 2, 1 << 20)
    kept = files.where(~F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED)))
    return kept.select("path", "content").dropDuplicates(["path"])


def is_test(path) -> object:
    """conftest.py, test_*, *_test.py, and files below test or tests."""
    base = F.element_at(F.split(path, "/"), -1)
    return (base == "conftest.py") | base.startswith("test_") | base.endswith("_test.py") | path.rlike(r"(^|/)tests?/")


_TEMPLATE = re.compile(r"\$\{[^}]*\}|\$[A-Za-z_]\w*")


def _string(node: ast.AST) -> str | None:
    """What a string literal, f-string or sum that begins with one says; None for other expressions."""
    rest = []
    while isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        rest.append(node.right)
        node = node.left
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        first = _TEMPLATE.sub("{}", node.value)
    elif isinstance(node, ast.JoinedStr):
        first = "".join("{}" if (part := _string(x)) is None else part for x in node.values)
    else:
        return None
    return first + "".join("{}" if (part := _string(x)) is None else part for x in reversed(rest))


#: Nodes of a called expression that is written out; of a longer one only its last name is, after `()`.
WRITTEN = 40


def _called(func: ast.AST) -> str | None:
    """The text of what is called: whole while short, so that a chain of calls takes time in proportion to its length."""
    open_, n = [func], 0
    while open_ and n <= WRITTEN:
        n += 1
        open_.extend(ast.iter_child_nodes(open_.pop()))
    if not open_:
        return ast.unparse(func)
    return f"().{func.attr}" if isinstance(func, ast.Attribute) else None


def _children(node: ast.AST):
    """(field, child) of the nodes that a node holds, in its order."""
    for field, held in ast.iter_fields(node):
        for child in held if isinstance(held, list) else [held]:
            if isinstance(child, ast.AST):
                yield field, child


def _rows(file: str, source: bytes) -> list[tuple]:
    """The nodes of a file.  What is open is a list and not the interpreter's stack, so depth doesn't matter here; what the parser itself finds too deep is an error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(file, 0, 0, None, "error", None, 1, 1, None, None, None)]
    out: list[list] = []
    columns: dict[int, int | None] = {}

    def add(parent, kind, text, node, role) -> int:
        line = getattr(node, "lineno", None) or (out[parent][6] if parent is not None else 1)
        inner = role == "left" and isinstance(node, ast.BinOp) and out[parent][4] == "binary_operator"  # of nested sums the outermost has the value
        out.append([file, len(out), None, parent, kind, text, line, getattr(node, "end_lineno", None) or line, None, role, None if inner else _string(node)])
        return len(out) - 1

    def close(here) -> None:
        out[here][2] = len(out) - 1

    def ends(node, here) -> None:
        for _ in node.ifs if isinstance(node, ast.comprehension) else ():
            close(add(here, "if_clause", None, node.target, "ifs"))
        close(here)

    def operators(node, parent, role) -> list:
        """a and b and c: one operator each, nested to the left; what comes after them."""
        above = []
        for _ in node.values[1:]:
            above.append(add(parent, "boolean_operator", type(node.op).__name__.lower(), node, role))
            parent, role = above[-1], "left"
        after = [(visit, node.values[0], above[-1], "left")]
        for value, here in zip(node.values[1:], reversed(above)):
            after += [(visit, value, here, "right"), (close, here)]
        return after

    def visit(node, parent, role) -> list | None:
        if isinstance(node, ast.expr_context):
            return None
        if isinstance(node, ast.BoolOp):
            return operators(node, parent, role)
        name = type(node).__name__
        text = getattr(node, "name", None) or getattr(node, "id", None) or getattr(node, "attr", None)
        if isinstance(node, ast.Constant):
            text = repr(node.value)
        elif isinstance(node, (ast.operator, ast.unaryop, ast.cmpop)):
            name, text = "operator", name
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            module = "." * (getattr(node, "level", 0) or 0) + (getattr(node, "module", None) or "")
            text = ",".join(a.name if isinstance(node, ast.Import) else f"{module}:{a.name}" for a in node.names)
        elif isinstance(node, ast.Call):
            text = _called(node.func)
        kind = KINDS.get(name, name.lower())
        if isinstance(node, ast.If) and role == "orelse" and parent is not None and out[parent][4] in ("if_statement", "elif_clause") and node.col_offset == columns[parent]:
            kind = "elif_clause"
        here = add(parent, kind, text if isinstance(text, str) else None, node, role)
        columns[here] = getattr(node, "col_offset", None)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out[here][8] = node.body[0].lineno
        return [*((visit, child, here, field) for field, child in _children(node)), (ends, node, here)]

    open_ = [(visit, tree, None, None)]
    while open_:
        do, *with_ = open_.pop()
        open_.extend(reversed(do(*with_) or ()))
    return [tuple(r) for r in out]


def parse(files: DataFrame) -> DataFrame:
    """nodes of files (path, content)."""

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32()}
        fields = [c.split() for c in NODES.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                columns = zip(*_rows(path, bytes(content or b"")))
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, NODES)
