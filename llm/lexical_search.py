"""Ranked lexical search: TPUT, three phases with a uniform threshold, over term-partitioned postings.

1. One scan of the documents counts the terms of the items in each text (and N, L over all texts), in bytes, in a worker.
   The postings get their integer scores and are written as lists: ordered by term and falling score, dealt out by ranges
   of (term, score, row), so a list as long as the table lies in many parts.
2. Heads: the k best entries of each list.  The whole scores of their documents give each item a lower bound, t1, of its
   k-th best score.
3. Uniform threshold: a document that shows up in none of an item's lists with more than x scores at most the sum of
   min(x, the list's top) over the lists.  x is SHARE of the largest number for which that sum stays below t1, and every
   list is fetched above x.  What is fetched gives a better bound, t2; a document stays a candidate while its sum and
   min(x, top) for each list that hasn't shown it reach t2.
4. Look-up: the candidates' scores are taken whole from the lists, and the best k are ranked.

Items are a stated query set.  They are taken in blocks whose different terms fit in `VOCABULARY` bytes, which is what a
worker's term table may hold; each block is a scan of the documents.  Nothing else goes to the driver but N, L and that table.

Edge cases: a null text has no terms; an item without terms, or whose terms no document has, gives no rows.  Rows repeated
with the same id are documents of their own, null ids rank last among equal scores, and each row of `items` is answered,
repeated ones too.  Empty tables give an empty result.  Other columns are never read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import LOWER, UPPER, small_side, written

TOP = 10
#: Bytes of different terms that one block of items may have, each counted with 64 bytes of its own.
VOCABULARY = 32 << 20
#: Postings that one part of the lists is meant to hold.
PART_ROWS = 1 << 20
#: Lists are fetched above this share of the largest threshold that is right: less of it fetches more, and leaves fewer candidates.
SHARE = 0.5
#: What a term may hold: digits, letters and all that isn't ASCII; A-Z are lowered and the rest separates.
TERMS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
POSTINGS = "term int, row bigint, doc_id bigint, tf int, n bigint"


def terms(text: bytes | None) -> Counter:
    """The terms of a text in UTF-8 and how often each occurs."""
    found = Counter((text or b"").translate(TERMS).split(b" "))
    found.pop(b"", None)
    return found


def _numbers():
    """Numbers for a task's rows that no other task gives."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 33
    while True:
        yield at
        at += 1


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(q, item, term, repeats) of every item's terms; q numbers the rows of items."""
    numbered = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa

        number = _numbers()
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                found, at = terms(text.as_py()), next(number)
                if found:
                    item = batch["item"].take(pa.array([i] * len(found), pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.int64()), item, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["q", "item", "term", "repeats"])

    return written(numbered.mapInArrow(run, f"q bigint, item {numbered.schema['item'].dataType.simpleString()}, term binary, repeats bigint"), "search-items")


def postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Entries of the vocabulary's terms (a broadcast dict of bytes to number), each with its text's number of terms n.

    Rows of term -1 are each batch's sums over all its texts: row has those with terms, n their terms, doc_id the most in one.
    """

    def run(batches):
        import pyarrow as pa

        known, number = vocabulary.value, _numbers()
        for batch in batches:
            term, row, doc, tf, n = [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found, at = terms(text.as_py()), next(number)
                if found:
                    hits = [(known[t], c) for t, c in found.items() if t in known]
                    term.append([t for t, _ in hits])
                    tf.append([c for _, c in hits])
                    row.append(at)
                    doc.append(doc_id)
                    n.append(found.total())
            if row:
                sizes = [len(x) for x in term]
                flat = lambda lists, kind: np.fromiter((x for one in lists for x in one), kind, sum(sizes))
                ids = pa.array(doc, pa.int64()).take(pa.array(np.repeat(np.arange(len(doc)), sizes)))
                yield pa.RecordBatch.from_arrays([pa.array(flat(term, np.int32)), pa.array(np.repeat(np.array(row, np.int64), sizes)), ids, pa.array(flat(tf, np.int32)), pa.array(np.repeat(np.array(n, np.int64), sizes))], names=["term", "row", "doc_id", "tf", "n"])
                yield pa.RecordBatch.from_pylist([{"term": -1, "row": len(row), "doc_id": max(n), "tf": 0, "n": sum(n)}], schema=pa.schema([("term", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("tf", pa.int32()), ("n", pa.int64())]))

    return written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, POSTINGS), "search-postings")


def scored_lists(entries: DataFrame) -> DataFrame:
    """(term, row, doc_id, score) with scores above 0, by term and falling score; an entry's score is for one occurrence in the item."""
    spark = entries.sparkSession
    total = entries.where("term < 0").agg(F.sum("row").alias("docs"), F.sum("n").alias("terms"), F.max("doc_id").alias("longest")).first()
    docs, length = total["docs"] or 0, max(total["terms"] or 0, 1)
    weights = entries.where("term >= 0").groupBy("term").agg(F.count("*").alias("df"))
    weights = weights.select("term", F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).cast("bigint").alias("w"), "df")
    weights = written(weights, "search-weights")
    count = weights.agg(F.sum("df")).first()[0] or 0
    wide = 75 * docs * (total["longest"] or 0) >= 1 << 62
    scaled = f"CAST(75 * CAST(n AS DECIMAL(18,0)) * {docs}BD div {length} AS BIGINT)" if wide else f"(75L * n * {docs}L) div {length}L"
    m = 25 + F.expr(scaled)
    score = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    lists = entries.where("term >= 0").join(small_side(weights, 24), "term").withColumn("m", m).select("term", "row", "doc_id", score.alias("score")).where("score > 0")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_ROWS))
    order = [F.col("term"), F.col("score").desc(), F.col("row")]
    return written(lists.repartitionByRange(parts, *order).sortWithinPartitions(*order), "search-lists")


def bounds(sums: DataFrame, k: int) -> DataFrame:
    """(q, bound): the k-th largest sum of each q, 0 where it has fewer."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "row"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("q").agg(F.when(F.count("*") == k, F.min("s")).otherwise(0).alias("bound"))


def looked_up(lists: DataFrame, wanted: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q, row, doc_id, s): the whole scores of pairs (q, row), from all lists."""
    found = lists.join(small_side(pairs.select("q", "row"), 32), "row").join(small_side(wanted.select("q", "term", "repeats"), 40), ["q", "term"])
    return found.groupBy("q", "row").agg(F.max("doc_id").alias("doc_id"), F.sum(F.col("score") * F.col("repeats")).alias("s"))


def tput(lists: DataFrame, wanted: DataFrame, k: int = TOP) -> DataFrame:
    """(q, rank, doc_id, score) of each q's k best rows.  wanted: q, term, repeats."""
    parts = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lists.count() // PART_ROWS))
    # heads: the k best of each list, and the whole scores of the rows in them
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.col("score").desc(), "row"))
    heads = written(lists.withColumn("rank", rank).where(F.col("rank") <= k).select("term", "row", "score"), "search-heads")
    tops = heads.groupBy("term").agg(F.max("score").alias("top"))
    wanted = written(wanted.join(small_side(tops, 24), "term").select("q", "term", "repeats", (F.col("top") * F.col("repeats")).alias("top")), "search-wanted")
    seen = written(heads.join(small_side(wanted, 40), "term").select("q", "row").distinct(), "search-seen")
    first = written(bounds(looked_up(lists, wanted, seen), k), "search-first")
    # the uniform threshold T = x + 1, from the largest x for which the lists, at x or their top each, stay below the bound
    own = Window.partitionBy("q").orderBy("top", "term")
    x = F.expr("(bound - 1 - below) div (lists - place + 1)")
    rising = wanted.join(small_side(first, 24), "q").withColumns({"below": F.sum("top").over(own) - F.col("top"), "place": F.row_number().over(own), "lists": F.count("*").over(Window.partitionBy("q"))})
    most = rising.groupBy("q").agg(F.floor(SHARE * F.greatest(F.lit(0), F.max(F.when(x < F.col("top"), x)))).cast("bigint").alias("x"))
    asked = written(wanted.join(small_side(most, 24), "q").select("q", "term", "repeats", F.least("top", "x").alias("cap"), F.expr("x div repeats + 1").alias("floor")), "search-asked")
    caps = asked.groupBy("q").agg(F.sum("cap").alias("caps"), F.count("*").alias("lists"))
    lowest = asked.groupBy("term").agg(F.min("floor").alias("lowest"))
    # an entry is sent to its row once, for all items that ask for it; sums of (q, row) need no further exchange
    entries = lists.join(small_side(lowest, 24), "term").where("score >= lowest").select("term", "row", "doc_id", "score").repartition(parts, "row")
    fetched = entries.join(small_side(asked, 48), "term").where("score >= floor").groupBy("q", "row").agg(F.max("doc_id").alias("doc_id"), F.sum(F.col("score") * F.col("repeats")).alias("s"), F.sum("cap").alias("cap"), F.count("*").alias("shown"))
    able = small_side(written(caps.join(small_side(first, 24), "q"), "search-caps"), 40)
    fetched = written(fetched.join(able, "q").where("s + caps - cap >= bound"), "search-fetched")
    left = fetched.drop("bound").join(small_side(bounds(fetched.drop("bound"), k).unionByName(first).groupBy("q").agg(F.max("bound").alias("bound")), 24), "q").where("s + caps - cap >= bound")
    left = written(left.select("q", "row", "doc_id", "s", (F.col("shown") == F.col("lists")).alias("whole")), "search-left")
    # look-up
    exact = left.where("whole").select("q", "row", "doc_id", "s").unionByName(looked_up(lists, wanted, left.where("NOT whole")))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("doc_id").asc_nulls_last(), "row"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "rank", "doc_id", F.col("s").alias("score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0."""
    spark: SparkSession = docs.sparkSession
    asked = item_terms(items, item_col, item_text_col)
    total = asked.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    blocks, found = -(-total // vocabulary), []
    for i in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)
        number = {bytes(r["term"]): i for i, r in enumerate(own.select("term").distinct().orderBy("term").collect())}
        shared = spark.sparkContext.broadcast(number)
        lists = scored_lists(postings(docs, shared, id_col, text_col))
        best = tput(lists, _numbered(own, shared), k)
        found.append(written(best.join(small_side(own.select("q", "item").distinct(), 64), "q").select(F.col("item").alias("item_id"), "rank", "doc_id", "score"), "search-best"))
    if not found:
        return spark.createDataFrame([], f"item_id {asked.schema['item'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _numbered(asked: DataFrame, vocabulary) -> DataFrame:
    """(q, term, repeats) with the terms' numbers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            number = [vocabulary.value[t] for t in batch["term"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["q"], pa.array(number, pa.int32()), batch["repeats"]], names=["q", "term", "repeats"])

    return asked.select("q", "term", "repeats").mapInArrow(run, "q bigint, term int, repeats bigint")
