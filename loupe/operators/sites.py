"""Mutation sites from tokens, with places that comments don't move, and the hash of a unit's code without its comments.

Shared columns, all places in bytes from a file's start and ends excluded: units (file, unit, start, end), comments (file, unit, start, end), of
the units they lie in, inline (file, unit, start, end), the inline units inside a unit, contents (file, content).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """The mutations of tokens (file, unit, start, end, kind, text, named, parent_kind, parent_start): file, unit, start, end, original_start, replacement.

    rules: rule, kind, text, replacement; kind is the token's own for `literal`, else its parent's.  Of these cases the first that a token's
    kinds fit decides, even where it has no replacement for the text: a literal (`literal`), nothing for a named or rootless token, a swap of an
    operator (`swap`), then a deletion (`delete`) and a deletion with the left operand (`left`), which starts where the parent does; those two
    have to fit the text too.  A rule row with a null text says only that tokens of its kind are in its case.
    """
    of = lambda name: rules.where(F.col("rule") == name).select("kind", "text", F.coalesce("replacement", F.lit("")).alias("new"))

    def case(rows: DataFrame, name: str, key: str) -> DataFrame:
        kinds = of(name).select(F.col("kind").alias(key), F.lit(True).alias(f"in_{name}")).distinct()
        texts = of(name).where("text IS NOT NULL").groupBy(F.col("kind").alias(key), "text").agg(F.min("new").alias(f"by_{name}"))
        return rows.join(F.broadcast(kinds), key, "left").join(F.broadcast(texts), [key, "text"], "left")  # rules are fixed tables of a language

    rows = tokens
    for name, key in (("literal", "kind"), ("swap", "parent_kind"), ("delete", "parent_kind"), ("left", "parent_kind")):
        rows = case(rows, name, key)
    bare = F.col("parent_kind").isNotNull() & ~F.coalesce("named", F.lit(False))
    chosen = F.when(F.col("in_literal"), F.struct(F.col("start").alias("from"), F.col("by_literal").alias("new"))).when(~bare, None).when(F.col("in_swap"), F.struct(F.col("start").alias("from"), F.col("by_swap").alias("new")))
    chosen = chosen.when(F.col("by_delete").isNotNull(), F.struct(F.col("start").alias("from"), F.lit("").alias("new"))).when(F.col("by_left").isNotNull(), F.struct(F.col("parent_start").alias("from"), F.lit("").alias("new")))
    found = rows.withColumn("chosen", chosen).where("chosen.new IS NOT NULL")
    return found.select("file", "unit", F.col("chosen.from").alias("start"), "end", F.col("chosen.new").alias("replacement"))


def _cut(content: bytes, start: int, end: int, comments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of a unit's text, what its comments (in order) take: each with the blanks and the line break that only it needed."""
    out: list[tuple[int, int]] = []
    for low, high in comments:
        while high > low and content[high - 1 : high] == b"\r":
            high -= 1
        before, after = low, high
        while before > start and content[before - 1 : before] in (b" ", b"\t"):
            before -= 1
        while after < end and content[after : after + 1] in (b" ", b"\t"):
            after += 1
        rest = content[after : min(after + 2, end)]
        line_break = 1 if rest[:1] == b"\n" else 2 if rest == b"\r\n" else 0
        begins, ends = before == start or content[before - 1 : before] == b"\n", after == end or line_break > 0
        if begins and ends:  # a line of its own goes whole; on the last line with the break before it
            low, high = before, after + line_break
            if not line_break and low > start:
                low -= 2 if content[max(start, low - 2) : low] == b"\r\n" else 1
        elif ends:
            low, high = before, after
        elif begins:
            high = after
        else:
            low = before
        low = max(low, out[-1][1]) if out else low
        if low < high:
            out.append((low, high))
    return out


def comment_cuts(units: DataFrame, comments: DataFrame, contents: DataFrame) -> DataFrame:
    """(file, unit, start, end): what comments take of their units' text.  A file's units and comments meet its content once, in one row."""
    span = F.struct("start", "end")
    held = comments.groupBy("file", "unit").agg(F.array_sort(F.collect_list(span)).alias("comments"))
    each = units.join(held, ["file", "unit"]).groupBy("file").agg(F.collect_list(F.struct("unit", "start", "end", "comments")).alias("units"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for file, content, all_ in zip(batch["file"].to_pylist(), batch["content"].to_pylist(), batch["units"].to_pylist()):
                for u in all_:
                    rows += [(file, u["unit"], a, b) for a, b in _cut(content or b"", u["start"], u["end"], [(c["start"], c["end"]) for c in u["comments"]])]
            kinds = [batch.schema.field("file").type, batch.schema.field("units").type.value_type.field("unit").type, pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["file", "unit", "start", "end"])

    types = {f.name: f.dataType.simpleString() for f in units.schema}
    rows = each.join(contents.select("file", F.col("content").cast("binary").alias("content")), "file")
    return rows.select("file", "content", "units").mapInArrow(run, f"file {types['file']}, unit {types['unit']}, start bigint, end bigint")


def offsets(sites: DataFrame, units: DataFrame, cuts: DataFrame) -> DataFrame:
    """sites (file, unit, start, ...) with offset: bytes from the unit's start, less what comments before it take.

    One pass over each unit's cuts and sites in order, so it is linear in them; a cut that ends after a site's start doesn't count.
    """
    site = F.struct(*(F.col(f"`{c}`") for c in sites.columns))
    marks = sites.select("file", "unit", F.col("start").alias("at"), F.lit(1).alias("turn"), F.lit(0).cast("bigint").alias("width"), site.alias("site"))
    taken = cuts.select("file", "unit", F.col("end").alias("at"), F.lit(0).alias("turn"), (F.col("end") - F.col("start")).alias("width"), F.lit(None).cast(marks.schema["site"].dataType).alias("site"))
    before = F.sum("width").over(Window.partitionBy("file", "unit").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0))
    placed = marks.unionByName(taken).withColumn("before", before).where("site IS NOT NULL").select("site.*", "before")
    return placed.join(units.select("file", "unit", F.col("start").alias("unit_start")), ["file", "unit"]).withColumn("offset", F.col("start") - F.col("unit_start") - F.col("before")).select(*sites.columns, "offset")


def code_hash(units: DataFrame, contents: DataFrame, inline: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """(file, unit, hash): 16 hex digits of the SHA-256 of a unit's bytes without its inline units and the cuts of its comments; without cuts, comments count.

    A change of comments alone keeps the hash; any other changes it.  The kept pieces of a file's units are taken from its content in one row.
    """
    gone = inline.select("file", "unit", "start", "end")
    gone = gone if cuts is None else gone.unionByName(cuts.select("file", "unit", "start", "end"))
    bounds = units.select("file", "unit", F.col("start").alias("low"), F.col("end").alias("high"))
    # each gap between what is gone so far and the next that goes; the unit's end closes the last
    stops = gone.join(bounds, ["file", "unit"]).unionByName(bounds.select("file", "unit", F.col("high").alias("start"), F.col("high").alias("end"), "low", "high"))
    so_far = F.max("end").over(Window.partitionBy("file", "unit").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    pieces = stops.withColumn("from", F.greatest("low", F.coalesce(so_far, "low"))).withColumn("to", F.least("start", "high"))
    kept = pieces.groupBy("file", "unit").agg(F.array_sort(F.collect_list(F.when(F.col("from") < F.col("to"), F.struct("from", "to")))).alias("pieces"))
    each = kept.groupBy("file").agg(F.collect_list(F.struct("unit", "pieces")).alias("units")).join(contents.select("file", F.col("content").cast("binary").alias("content")), "file")
    take = lambda p: F.hex(F.substring(F.col("content"), (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))
    hashed = F.transform("units", lambda u: F.struct(u["unit"].alias("unit"), F.substring(F.sha2(F.unhex(F.array_join(F.transform(u["pieces"], take), "")), 256), 1, 16).alias("hash")))
    return each.select("file", F.explode(hashed).alias("u")).select("file", "u.unit", "u.hash")
