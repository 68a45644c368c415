"""Exact dedup by a Golomb-coded fingerprint exchange.

1. Each source (a part of an input partition) sorts the 64-bit fingerprints of its texts and sends
   every owner of a fingerprint range its own distinct ones, as Golomb-Rice coded gaps.
2. An owner decodes the lists, finds fingerprints that several sources have, and answers each list
   with a bitmap.
3. Sources get the bitmaps (broadcast within BROADCAST_BYTES, else by a shuffle that their rows join) and expand them: a row is a suspect if its bit is set or its source has it twice.
4. Only suspects' texts are shuffled.  They are grouped by all their bytes, after map-side
   aggregation, so a text that a third of all rows share crosses the network once a task.

Edge cases: a null text is an empty text, null ids rank below all others, of rows repeated with the
same id exactly one stays, an empty table gives an empty result, other columns are never read
(`deduplicate` hands them on).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import BROADCAST_BYTES, ascii_lower, row_digest, small_side, whole, without, written

#: Rows of a source at most: its lists are built in one worker's memory.
SOURCE_ROWS = 1 << 19
#: Fingerprints that one owner is meant to sort.
OWNER_ROWS = 1 << 20


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(k, unary part, remainders) of the gaps of sorted distinct unsigned 64-bit integers.

    A gap is quotient * 2**k + remainder; quotients are in unary (ones, then a zero), remainders in k bits each.
    """
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / len(values)
    k = min(63, max(0, int(np.log2(max(mean * 0.69, 1)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(bits).tobytes()


def rice_decode(n: int, k: int, unary: bytes, remainders: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(remainders, np.uint8), count=n * k).reshape(n, k)
        for i in range(k):
            gaps |= bits[:, i].astype(np.uint64) << np.uint64(i)
    return np.cumsum(gaps, dtype=np.uint64)


LISTS = "src bigint, owner int, n int, k int, unary binary, remainders binary, counts binary, ids array<bigint>, refs array<bigint>, shas array<binary>"


def _send(owners: int):
    width = np.uint64(-(-(1 << 64) // owners))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, chunk = TaskContext.get().partitionId(), 0

        def flush(parts):
            nonlocal chunk
            table = pa.Table.from_batches(parts).combine_chunks()
            shas = table["sha"].combine_chunks()
            raw = np.frombuffer(b"".join(shas.to_pylist()), np.uint8).reshape(-1, 32)
            prints = np.ascontiguousarray(raw[:, :8]).view(">u8").ravel().astype(np.uint64)
            order = np.argsort(prints, kind="stable")
            prints = prints[order]
            values, first, counts = np.unique(prints, return_index=True, return_counts=True)
            own = (values // width).astype(np.int64)
            ids, src = table["id"].combine_chunks().take(pa.array(order)), (task << 20) | chunk
            shas, edges = shas.take(pa.array(order)), np.flatnonzero(np.diff(own, prepend=-1, append=owners))
            for a, b in zip(edges[:-1], edges[1:]):
                lo, hi = first[a], first[b - 1] + counts[b - 1]
                k, unary, remainders = rice_encode(values[a:b] - np.uint64(own[a]) * width)
                refs = pa.array((np.int64(src) << 19) + np.arange(lo, hi, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([src], pa.int64()), pa.array([own[a]], pa.int32()), pa.array([b - a], pa.int32()), pa.array([k], pa.int32()), pa.array([unary]), pa.array([remainders]), pa.array([counts[a:b].astype("<i4").tobytes()])]
                    + [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x) for x in (ids.slice(lo, hi - lo), refs, shas.slice(lo, hi - lo))],
                    names=["src", "owner", "n", "k", "unary", "remainders", "counts", "ids", "refs", "shas"],
                )
            chunk += 1

        parts, rows = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, SOURCE_ROWS):
                piece = batch.slice(i, SOURCE_ROWS)
                if rows + piece.num_rows > SOURCE_ROWS:
                    yield from flush(parts)
                    parts, rows = [], 0
                parts.append(piece)
                rows += piece.num_rows
        if rows:
            yield from flush(parts)

    return run


def _answer(table):
    """Bitmaps of one owner: the bits of fingerprints that more than one source has."""
    import pyarrow as pa

    rows = table.to_pylist()
    lists = [rice_decode(r["n"], r["k"], r["unary"], r["remainders"]) for r in rows]
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared, at, maps = counts[inverse] > 1, 0, []
    for one in lists:
        maps.append(np.packbits(shared[at : at + len(one)]).tobytes())
        at += len(one)
    return pa.table({"src": pa.array([r["src"] for r in rows], pa.int64()), "owner": pa.array([r["owner"] for r in rows], pa.int32()), "bitmap": pa.array(maps, pa.binary())})


def _receive(batches):
    """A row for each document, with its suspect flag."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            n = row["n"][0].as_py()
            counts = np.frombuffer(row["counts"][0].as_py(), "<i4")
            bits = np.unpackbits(np.frombuffer(row["bitmap"][0].as_py(), np.uint8), count=n).astype(bool) | (counts > 1)
            yield pa.RecordBatch.from_arrays([row["ids"].flatten(), row["refs"].flatten(), row["shas"].flatten(), pa.array(np.repeat(bits, counts))], names=["id", "ref", "sha", "suspect"])


def fingerprint_exchange(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(id, ref, sha, suspect) of each row; ref is a number of its own for each row.  Written to the shared folder."""
    spark = docs.sparkSession
    text = whole("text") if text is None else text
    prints = docs.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // OWNER_ROWS))
    lists = written(prints.mapInArrow(_send(owners), LISTS), "dedup-lists")
    bitmaps = written(lists.select("src", "owner", "n", "k", "unary", "remainders").groupBy("owner").applyInArrow(_answer, "src bigint, owner int, bitmap binary"), "dedup-bitmaps")
    # a bit a fingerprint: while they may be broadcast, lists stay where they are and nothing but bitmaps travels back
    if (bitmaps.agg(F.sum(F.length("bitmap") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        bitmaps = F.broadcast(bitmaps)
    members = lists.select("src", "owner", "n", "counts", "ids", "refs", "shas").join(bitmaps, ["src", "owner"])
    return written(members.mapInArrow(_receive, "id bigint, ref bigint, sha binary, suspect boolean"), "dedup-members")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=ascii_lower) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.  Of equal normalised texts the row with the largest id stays."""
    text = normalise(whole(text_col))
    members = fingerprint_exchange(docs, id_col, text)
    suspects = members.where("suspect")
    prints = written(suspects.groupBy("sha").agg(F.max(F.struct("id", "ref")).alias("top")), "dedup-suspects")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    same = texts.join(small_side(prints.select("sha"), 64), "sha", "left_semi").groupBy("sha", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # equal digests of different bytes would give one digest two rows here, and the join below an error instead of a wrong group
    same = same.groupBy("sha").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts"))
    same = same.join(prints, "sha").select("sha", "keep_id", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("different texts with equal SHA-256"))).alias("group_size"), F.col("top.ref").alias("keep_ref"))
    same = written(same, "dedup-groups")
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    alone = members.where("not suspect").select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), digest)
    grouped = suspects.join(same, "sha").select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("ref") == F.col("keep_ref")).alias("kept"), digest)
    return alone.unionByName(grouped)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, less the rows that exact_groups drops."""
    groups = written(exact_groups(docs, id_col, text_col), "dedup-result")
    big = groups.where("group_size > 1")
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.lower(F.hex(F.unhex(F.sha2(ascii_lower(whole(text_col)), 256)))).alias("text_sha256"), row_digest(F.col(text_col)).alias("digest"))
    kept = big.groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    keys = written(ids.join(kept, ids["doc_id"].eqNullSafe(kept["doc_id"]) & (ids["text_sha256"] == kept["text_sha256"])).select("key", "digest", "kept", "n").distinct(), "dedup-keys")
    return without(docs, keys.where("not kept").select("key", "digest"), keys.where("kept and n > 1").select("key", "digest"), id_col, text_col)
