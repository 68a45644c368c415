"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of `window` words (all its words, if it has fewer).  A window is held as
the set of its q-word shingles; it occurs in a document only if all its shingles do, so the necessary
prefix is one shingle, and the rarest in the documents is taken.

1. Documents are cut into words once; places whose shingle is one of the benchmark's are kept, each
   with the words around it that a window could reach (the only part of a text that moves on).
2. Shingles are counted over all documents; each window keeps its rarest, or none if one never occurs.
3. Places join windows on that shingle.  The shingle's position in the window gives the only place
   where the window could begin; it has to lie inside the document (position and length bounds), and
   the words there have to be the window's.
4. Occurrences of a document are merged as intervals, so overlaps count words once.

Up to LITERALS benchmark shingles reach the scan as literals of one pass.  More of them are a broadcast table
that places are joined with inside the scan's stage, so no place moves before it is known to match: a pass over the
documents for each SHINGLES_A_PASS, as many as stay under the bound of a broadcast.

Edge cases: null and empty texts have no words; repeated rows are documents of their own; items without
words have no window, items with equal ids count as one, a null item id is written as nothing; empty
tables give no rows or no hits; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import BROADCAST_BYTES, ascii_lower, row_digest, small_side, whole, without, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 4
#: Shingles up to which they are literals; bytes of one in a broadcast table, and those of a pass (a fifth less than fit, as they are dealt by hash).
LITERALS = 50_000
TOKEN_BYTES = 40
SHINGLES_A_PASS = BROADCAST_BYTES // TOKEN_BYTES * 4 // 5


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(ascii_lower(whole(text)), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, w, size): every window of every item, its words joined by blanks."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(text_col).alias("words")).where("size(words) > 0")
    items = items.select("item", "words", F.least(F.size("words"), F.lit(window)).alias("size"))
    starts = items.select("item", "words", "size", F.explode(F.expr("sequence(1, size(words) - size + 1)")).alias("at"))
    return starts.select("item", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("w"), "size").distinct()


def shingles(windows_: DataFrame, q: int = SHINGLE) -> DataFrame:
    """(w, size, q, offset, h) of every shingle of every distinct window; shorter windows have shingles of their own size."""
    rows = windows_.select("w", "size").distinct().withColumn("q", F.least("size", F.lit(q))).withColumn("words", F.split("w", " "))
    rows = rows.select("w", "size", "q", "words", F.explode(F.expr("sequence(0, size - q)")).alias("offset"))
    return rows.select("w", "size", "q", "offset", F.xxhash64(F.slice("words", F.col("offset") + 1, F.col("q"))).alias("h"))


def _around(pos: str, reach: str, q: str, words_: str = "words") -> str:
    """Fields of a place: the first word that a window over it could hold, and the words from there on."""
    return f"greatest(0, {pos} - {reach}) AS first, slice({words_}, greatest(0, {pos} - {reach}) + 1, {pos} - greatest(0, {pos} - {reach}) + {q} + {reach}) AS around"


def _matches(q: int, hashes: list[int], window: int) -> Column:
    """Places of a document whose q-word shingle is in hashes, with the words that windows over them can hold."""
    known = ", ".join(f"{h}L" for h in hashes)
    return F.expr(
        f"CASE WHEN n_words >= {q} THEN transform(filter(sequence(0, n_words - {q}), i -> xxhash64(slice(words, i + 1, {q})) IN ({known})), "
        f"i -> struct(i AS pos, {q} AS q, xxhash64(slice(words, i + 1, {q})) AS h, {_around('i', str(window - q), str(q))})) ELSE array() END"
    )


def _by_literals(rows: DataFrame, tokens: DataFrame, window: int) -> tuple[DataFrame, DataFrame | None]:
    """(documents, places) by one pass with all shingles (q, h) as literals."""
    block: dict[int, list[int]] = {}
    for r in tokens.orderBy("q", "h").toLocalIterator():
        block.setdefault(r["q"], []).append(r["h"])
    matches = [F.concat(*(_matches(k, hashes, max(window, k)) for k, hashes in block.items())).alias("matches")] if block else []
    part = written(rows.select("row", "doc_id", "digest", F.col("n_words").cast("bigint").alias("n_words"), *matches), "leaks-places")
    return part.select("row", "doc_id", "digest", "n_words"), part.select("row", "n_words", F.explode("matches").alias("m")).select("row", "n_words", "m.*") if block else None


def _by_joins(rows: DataFrame, tokens: DataFrame, n: int, window: int) -> tuple[DataFrame, DataFrame]:
    """(documents, places) by a pass for each block of shingles (q, h), dealt by hash; a document's own row has place -1."""
    sizes = [r["q"] for r in tokens.select("q").distinct().orderBy("q").collect()]  # window at most
    own = F.expr("array(struct(-1 AS pos, 0 AS q, CAST(NULL AS bigint) AS h))")
    at = [F.expr(f"CASE WHEN n_words >= {q} THEN transform(sequence(0, n_words - {q}), i -> struct(i AS pos, {q} AS q, xxhash64(slice(words, i + 1, {q})) AS h)) ELSE array() END") for q in sizes]
    every = rows.select("row", "doc_id", "digest", "n_words", "words", F.explode(F.concat(own, *at)).alias("p")).select("row", "doc_id", "digest", "n_words", "words", "p.*")
    blocks, documents, found = -(-n // SHINGLES_A_PASS), None, None
    for i in range(blocks):
        block = tokens.where(F.pmod(F.xxhash64("h", "q"), F.lit(blocks)) == i).select(F.col("h").alias("known"), F.col("q").alias("known_q"))
        met = every.join(small_side(block, TOKEN_BYTES), (F.col("h") == F.col("known")) & (F.col("q") == F.col("known_q")), "left").where("pos < 0 OR known IS NOT NULL")
        around = F.expr(f"CASE WHEN pos >= 0 THEN struct({_around('pos', f'(greatest({window}, q) - q)', 'q')}) END")
        part = written(met.select("row", "doc_id", "digest", F.col("n_words").cast("bigint").alias("n_words"), "pos", "q", "h", around.alias("m")), "leaks-places")
        if documents is None:
            documents = part.where("pos < 0").select("row", "doc_id", "digest", "n_words")
        part = part.where("pos >= 0").select("row", "doc_id", "digest", "n_words", "pos", "q", "h", "m.*")
        if i:  # row numbers are those of the first pass; rows with equal ids and texts have equal places
            again = part.drop("row").dropDuplicates(["doc_id", "digest", "pos", "q"])
            first = documents.select("row", F.col("doc_id").alias("d"), F.col("digest").alias("t"))
            part = again.join(first, again["doc_id"].eqNullSafe(first["d"]) & (again["digest"] == first["t"]))
        places = part.select("row", "n_words", "pos", "q", "h", "first", "around")
        found = places if found is None else found.unionByName(places)
    return documents, found


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, q: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: row, doc_id, digest, n_words; occurrences: row, start, size, w; windows: item, w, size), all written."""
    spans = written(windows(benchmark, window, item_col), "leaks-windows")
    tokens = written(shingles(spans, q), "leaks-shingles")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = base.select("doc_id", row_digest(F.col("text")).alias("digest"), words("text").alias("words"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "digest", "words", F.size("words").alias("n_words"))
    distinct = written(tokens.select("q", "h").distinct(), "leaks-known")
    n = distinct.count()
    documents, found = _by_literals(rows, distinct, window) if n <= LITERALS else _by_joins(rows, distinct, n, window)
    if found is None:
        return documents, docs.sparkSession.createDataFrame([], "row bigint, start int, size int, w string"), spans
    counts = found.groupBy("q", "h").agg(F.count("*").alias("n"))
    rarest = tokens.join(counts, ["q", "h"], "left").groupBy("w", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset", "q")).alias("t"))
    prefix = written(rarest.where("t.n > 0").select("w", "size", "t.q", "t.h", "t.offset"), "leaks-prefixes")
    starts = found.join(prefix, ["q", "h"]).withColumn("start", F.col("pos") - F.col("offset"))
    inside = starts.where("start >= 0 AND start + size <= n_words AND start >= first")
    same = inside.where(F.array_join(F.slice("around", F.col("start") - F.col("first") + 1, F.col("size")), " ") == F.col("w"))
    return documents, written(same.select("row", "start", "size", "w"), "leaks-occurrences"), spans


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, q: int = SHINGLE, **columns) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the digest of the text as it stands, of every row."""
    documents, found, spans = occurrences(docs, benchmark, window, q, **columns)
    order = Window.partitionBy("row").orderBy("start", "size")
    before = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.select("row", "start", "size").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    hits = runs.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", "before"))).cast("bigint").alias("n_hit"))
    listed = found.select("row", "w").distinct().join(spans.select("item", "w"), "w").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    rows = documents.join(hits, "row", "left").join(listed, "row", "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "digest",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, q: int = SHINGLE, **columns) -> DataFrame:
    """docs, all columns, less the contaminated rows."""
    dirty = contamination(docs, benchmark, window, q, **columns).where("contaminated")
    keys = written(dirty.select(F.col("doc_id").cast("string").alias("key"), "digest").distinct(), "leaks-dropped")
    return without(docs, keys, None, columns.get("id_col", "doc_id"), columns.get("text_col", "text"))
