"""HTTP routes that files serve and requests that they make, from the `nodes` relation of Python code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.functions import paths

#: Names that stand for a method, decorators that leave it open, and objects that requests are made on.
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
ANY_METHOD = ("route", "api_route", "websocket")
CLIENTS = ("requests", "httpx", "session", "client", "http")


def callee(text: Column) -> tuple[Column, Column]:
    """(object, name) of a called expression: "client" and "get" for self.client.get; the object of a bare name is empty."""
    before = F.regexp_extract(text, r"^(?s)(.*)\.\w+$", 1)
    last = F.regexp_extract(before, r"([^.)]+)$", 1)
    return F.when(last != "", last).otherwise(before), F.regexp_extract(text, r"^(?:(?s).*\.)?(\w+)$", 1)


def endpoints(nodes: DataFrame) -> DataFrame:
    """(file, side, method, path, line): `serves` for a decorator that names a route, `calls` for a request by a known client.

    A path counts where the first argument is a string (sums and f-strings: {} for what isn't literal) that is a
    route; a request needs a segment that is no parameter.  The method is empty where the code leaves it open.
    """
    first = nodes.where("role = 'args'").groupBy("file", F.col("parent").alias("pre")).agg(F.min_by(F.struct("value"), "pre").alias("first"))
    object_, name = callee(F.col("text"))
    calls = nodes.where("kind = 'call' AND text IS NOT NULL").select("file", "pre", "role", F.col("start_line").alias("line"), object_.alias("object"), name.alias("name"))
    rows = calls.join(first, ["file", "pre"]).withColumn("raw", F.col("first.value")).where("raw IS NOT NULL")
    verb = F.lower("name").isin(*VERBS)
    open_ = F.col("name").isin(*ANY_METHOD)
    method = F.when(open_, "").otherwise(F.upper("name"))
    path = paths.normalise_route(F.col("raw"))
    served = rows.where((F.col("role") == "decorator_list") & (verb | open_) & F.col("raw").startswith("/")).select("file", F.lit("serves").alias("side"), method.alias("method"), path.alias("path"), "line").where("path IS NOT NULL")
    asked = rows.where(verb & F.col("object").isin(*CLIENTS)).select("file", F.lit("calls").alias("side"), F.upper("name").alias("method"), path.alias("path"), "line")
    return served.unionByName(asked.where(F.col("path").isNotNull() & paths.has_literal(F.col("path"))))


def route_sides(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, serves) by module, as `graph.http_edges` takes them."""
    rows = found.select("side", paths.module_of(F.col("file")).alias("module"), "method", "path")
    return rows.where("side = 'calls'").drop("side"), rows.where("side = 'serves'").drop("side")
