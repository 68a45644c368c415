"""Suffix-array dedup: repeated byte strings, by a difference-cover sample and suffixes sorted a bucket at a time.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.  The order of
suffixes beyond LENGTH bytes bears on nothing, so suffixes are compared to that depth.

1. Copies: of equal texts (by SHA-256) those with the smallest id stand for all; each byte of the others goes, if they have
   LENGTH.  Blocks: the texts that are left are written once, as compressed files of some BLOCK bytes, named in a manifest.
2. Cover sample: the places of a block whose number modulo MODULUS is in COVER.  Any two places reach sampled ones by one
   common step of less than MODULUS bytes, so two equal strings of LENGTH bytes share a sampled string of DEPTH =
   LENGTH - MODULUS + 1 bytes.  Sampled suffixes are ranked to DEPTH bytes first: blocks send each owner of a range of
   ranks their sorted, distinct ones as Golomb-Rice coded gaps, and get a bitmap of those that others have too.
3. Suffixes: a suffix with no shared sampled rank in its first bytes can't repeat, and only the others are sorted: those are
   the long ties that the sample's ranks tell beforehand.  Blocks send them by range of key (a suffix bucket) with the
   smallest document id each; an owner sorts one bucket at a time, finds each string's smallest id, and answers with bitmaps.
4. A block turns the answered suffixes into bytes and returns its documents' figures.

A rank or key is a fingerprint of the bytes and not their place in lexicographic order: equality and the smallest id are all
that the result needs, and lists of fingerprints are some 6 bytes a suffix where the suffixes' own bytes are 50.  Keys are as
wide as the number of suffixes asks: two different strings of the whole corpus share a key with a chance below 2^-10.  Ranks
of the sample are narrower; one that agrees by chance only makes suffixes candidates.

A block sends a string once, however often it has it, so no owner gets more than one entry a block for a string that a
third of all documents hold.  A worker holds one block (a document that is longer is one by itself) or one bucket.

Edge cases: null and empty texts have no bytes; rows with equal ids don't repeat one another; a null id ranks as the largest
bigint; texts under LENGTH bytes stay whole; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import file_system, shared_folder, small_side, whole, written
from llm.exact_dedup import rice_decode, rice_encode

LENGTH = 50
#: A perfect difference set: every step from 1 to 20 is a difference of two of its members modulo 21, in one way.
MODULUS, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of text in a block, and entries that a bucket is meant to have.
BLOCK, BUCKET = 4 << 20, 1 << 21
NO_ID = (1 << 63) - 1
MANIFEST = "file string, n_bytes bigint"
LISTS = "bucket int, file string, n int, k int, unary binary, remainders binary, more binary, ids binary"
ANSWERS = "file string, step int, bucket int, n int, bitmap binary"


def fingerprints(words: np.ndarray, at: np.ndarray, length: int, seed: int) -> np.ndarray:
    """64-bit fingerprints of the `length` bytes at each place; words: the eight bytes from every place on."""
    h = np.full(len(at), seed * 0x9E3779B97F4A7C15 + length & (1 << 64) - 1, np.uint64)
    for step in [*range(0, length - 8, 8), length - 8]:
        h ^= words[at + step] * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xC4CEB9FE1A85EC53 + 2 * seed)
        h ^= h >> np.uint64(29)
    return h


def planes(values: np.ndarray) -> bytes:
    """The first, second, ... bytes of all values, one after another: high ones that are equal compress to nothing."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Block:
    """The texts of one file, end to end, with what the sample and the suffixes need."""

    def __init__(self, file: str, length: int):
        import pyarrow.feather as feather

        fs, path = file_system(file)
        with fs.open_input_file(path) as source:
            table = feather.read_table(source).combine_chunks()
        self.file, self.length, self.depth = file, length, length - MODULUS + 1
        self.digests = table["digest"]
        texts = table["text"].combine_chunks()
        self.lengths = np.diff(np.frombuffer(texts.buffers()[1], "<i8" if "large" in str(texts.type) else "<i4", len(texts) + 1, texts.offset * 4)) if len(texts) else np.zeros(0, np.int64)
        self.n = int(self.lengths.sum())
        self.bytes = np.zeros(self.n + length + 8, np.uint8)
        if self.n:
            self.bytes[: self.n] = np.frombuffer(texts.buffers()[2], np.uint8, self.n)
        self.words = np.ndarray((self.n + length,), "<u8", self.bytes, strides=(1,))
        self.ends = np.cumsum(self.lengths, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        self.rank = np.array([NO_ID if x is None else x for x in table["doc_id"].to_pylist()], np.int64)

    def sample(self, bits: int) -> None:
        """places, their ranks' numbers among the block's distinct `ranks`, and which of those two of its documents have."""
        places = (np.arange(0, self.n, MODULUS, dtype=np.int64)[:, None] + np.array(COVER)).ravel()
        places = places[places < self.n]
        self.places = places[places + self.depth <= self.ends[self.doc[places]]]
        prints = fingerprints(self.words, self.places, self.depth, 1) >> np.uint64(64 - bits)
        self.ranks, self.which = np.unique(prints, return_inverse=True)
        ids = self.rank[self.doc[self.places]]
        low, high = np.full(len(self.ranks), NO_ID), np.full(len(self.ranks), -NO_ID - 1)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        self.own = low < high

    def suffixes(self, shared: np.ndarray) -> None:
        """at: places of suffixes with a shared rank within reach; keys, more: their distinct keys; to: each one's number among
        them; least: each key's smallest document id here."""
        hit = self.places[(shared | self.own)[self.which]]
        edge = np.bincount(np.maximum(hit - MODULUS + 1, 0), minlength=self.n + 1) - np.bincount(hit + 1, minlength=self.n + 1)
        at = np.flatnonzero(np.cumsum(edge)[: self.n] > 0)
        self.at = at[at + self.length <= self.ends[self.doc[at]]]
        keys, more = fingerprints(self.words, self.at, self.length, 2), fingerprints(self.words, self.at, self.length, 3)
        order = _sorted(keys, more)
        keys, more = keys[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.more = keys[first], more[first]
        self.to = np.empty(len(self.at), np.int64)
        self.to[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
        ids = self.rank[self.doc[self.at]]
        self.least = np.minimum.reduceat(ids[order], first) if len(first) else ids

    def result(self, earlier: np.ndarray):
        """A row for each document; earlier: for each key, whether a smaller id than `least` has it."""
        import pyarrow as pa

        gone = self.at[earlier[self.to] | (self.rank[self.doc[self.at]] > self.least[self.to])]
        edge = np.bincount(gone, minlength=self.n + 1) - np.bincount(gone + self.length, minlength=self.n + 1)
        covered = np.cumsum(edge)[: self.n] > 0
        starts = self.ends - self.lengths
        sums = np.concatenate([[0], np.cumsum(covered)])
        begins = covered.copy()
        begins[1:] &= ~covered[:-1] | (self.doc[1:] != self.doc[:-1])
        runs = np.concatenate([[0], np.cumsum(begins)])
        removed, spans = sums[self.ends] - sums[starts], runs[self.ends] - runs[starts]
        digests = []
        for a, b, r in zip(starts, self.ends, removed):
            digests.append(hashlib.sha256(self.bytes[a:b][~covered[a:b]] if r else self.bytes[a:b]).hexdigest())
        return pa.table({"digest": self.digests, "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def _sorted(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The order of (key, more).  The slower sort by both is only needed where equal keys differ in their second halves."""
    order = np.argsort(keys, kind="stable")
    a, b = keys[order], more[order]
    return np.lexsort((more, keys)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


def write_blocks(docs: DataFrame, folder: str, block: int) -> DataFrame:
    """Writes the texts of (doc_id, digest, text) as block files; the manifest."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.feather as feather

        def flush(parts, size):
            file = f"{folder}/block-{uuid.uuid4().hex}.arrow"
            fs, path = file_system(file)
            fs.create_dir(path.rpartition("/")[0])
            with fs.open_output_stream(path, compression=None) as out:
                feather.write_feather(pa.Table.from_batches(parts), out, compression="zstd", compression_level=6, chunksize=(1 << 31) - 1)
            return pa.RecordBatch.from_pylist([{"file": file, "n_bytes": size}], schema=pa.schema([("file", pa.string()), ("n_bytes", pa.int64())]))

        parts, held = [], 0
        for batch in batches:
            sizes, begin = pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False), 0
            for i, size in enumerate(sizes):
                if held and held + size > block:
                    yield flush([*parts, *([batch.slice(begin, i - begin)] if i > begin else [])], held)
                    parts, held, begin = [], 0, i
                held += int(size)
            parts.append(batch.slice(begin))
        if sum(p.num_rows for p in parts):
            yield flush(parts, held)

    return _exchanged(docs.select("doc_id", "digest", F.col("text").cast("binary").alias("text")).mapInArrow(run, MANIFEST), "suffix-blocks")


def _lists(file: str, keys: np.ndarray, buckets: int, bits: int, more: np.ndarray | None = None, extra: int = 0, ids: np.ndarray | None = None):
    """The list of a block for each bucket that it has keys of."""
    import pyarrow as pa

    width = np.uint64(-(-(1 << bits) // buckets))
    own = (keys // width).astype(np.int64)
    edges = np.flatnonzero(np.diff(own, prepend=-1, append=buckets))
    rows = []
    for a, b in zip(edges[:-1], edges[1:]):
        k, unary, remainders = rice_encode(keys[a:b] - np.uint64(own[a]) * width)
        tail = more[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :extra].tobytes() if extra else b""
        rows.append((own[a], file, b - a, k, unary, remainders, tail, b"" if ids is None else planes(ids[a:b])))
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=LISTS.replace(" int", "").replace(" string", "").replace(" binary", "").split(", "))


def _answer(step: int, extra: int):
    """Bitmaps for one bucket.  Step 1: ranks that several blocks have.  Step 2: keys that some block has with a smaller id."""

    def run(table):
        import pyarrow as pa

        n, k = table["n"].to_pylist(), table["k"].to_pylist()
        keys = np.concatenate([rice_decode(*x) for x in zip(n, k, table["unary"].to_pylist(), table["remainders"].to_pylist())])
        if extra:
            tail = np.zeros((len(keys), 8), np.uint8)
            tail[:, :extra] = np.frombuffer(b"".join(table["more"].to_pylist()), np.uint8).reshape(-1, extra)
            tail = tail.view("<u8").ravel()
        order = _sorted(keys, tail) if extra else np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        new = sorted_[1:] != sorted_[:-1]
        if extra:
            new |= tail[order][1:] != tail[order][:-1]
        first = np.flatnonzero(np.concatenate([[True], new]))
        sizes = np.diff(first, append=len(keys))
        flags = np.empty(len(keys), bool)
        if step == 1:
            flags[order] = np.repeat(sizes > 1, sizes)
        else:
            ids = np.concatenate([unplanes(x) for x in table["ids"].to_pylist()])[order]
            flags[order] = ids > np.repeat(np.minimum.reduceat(ids, first), sizes)
        at, maps = np.cumsum([0, *n]), []
        for a, b in zip(at[:-1], at[1:]):
            maps.append(np.packbits(flags[a:b]).tobytes())
        return pa.table({"file": table["file"], "step": pa.array([step] * len(n), pa.int32()), "bucket": table["bucket"], "n": table["n"], "bitmap": pa.array(maps, pa.binary())})

    return run


def _bits(table, step: int) -> np.ndarray:
    """A block's answers of one step, in the order of its keys."""
    rows = sorted(((r["bucket"], r["n"], r["bitmap"]) for r in table.to_pylist() if r["step"] == step), key=lambda r: r[0])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for _, n, b in rows)])


#: Lets Spark delete a query's shuffle files when it ends: what is read again here are written tables.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _exchanged(df: DataFrame, name: str) -> DataFrame:
    """The table written, and the shuffle files of its query deleted."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(CLEANUP, before)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    if length < MODULUS + 7:
        raise ValueError(f"length has to be {MODULUS + 7} at least, so that sampled strings have 8 bytes")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rank = F.coalesce("doc_id", F.lit(NO_ID))
    rows = written(texts.select("doc_id", "digest", F.octet_length("text").cast("bigint").alias("n_bytes")), "suffix-rows")
    copied = rows.groupBy("digest").agg(F.min(rank).alias("least"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    copied = small_side(written(copied, "suffix-copied"), 80)
    later = F.col("least").isNotNull() & (rank > F.col("least"))
    firsts = texts.join(copied, "digest", "left").where(~later)
    blocks = write_blocks(firsts, folder or shared_folder(spark, "suffix-texts"), block)
    total = blocks.agg(F.count("*").alias("files"), F.sum("n_bytes").alias("n")).first()
    files, n = max(1, total["files"]), total["n"] or 0
    least = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sampled = n * len(COVER) // MODULUS + 1
    bits = min(64, sampled.bit_length() + 9)
    ranks = max(least, -(-sampled // bucket))

    def first(batches):
        for batch in batches:
            for file in batch["file"].to_pylist():
                b = Block(file, length)
                b.sample(bits)
                yield _lists(file, b.ranks, ranks, bits)

    lists = blocks.select("file").repartition(files, "file").mapInArrow(first, LISTS)
    shared = _exchanged(lists.repartition(ranks, "bucket").groupBy("bucket").applyInArrow(_answer(1, 0), ANSWERS), "suffix-shared")

    keys = max(least, -(-n // (4 * bucket)))
    extra = min(8, max(0, -(-(2 * n.bit_length() + 10 - 64) // 8)))
    none = F.lit(None).cast("binary")
    known = blocks.select("file", F.lit(0).alias("step"), F.lit(0).alias("bucket"), F.lit(0).alias("n"), none.alias("bitmap"))

    def second(table):
        import pyarrow as pa

        b = Block(table["file"][0].as_py(), length)
        b.sample(bits)
        b.suffixes(_bits(table, 1))
        return pa.Table.from_batches([_lists(b.file, b.keys, keys, 64, b.more, extra, b.least)])

    lists = known.unionByName(shared).repartition(files, "file").groupBy("file").applyInArrow(second, LISTS)
    earlier = _exchanged(lists.repartition(keys, "bucket").groupBy("bucket").applyInArrow(_answer(2, extra), ANSWERS), "suffix-earlier")

    def third(table):
        b = Block(table["file"][0].as_py(), length)
        b.sample(bits)
        b.suffixes(_bits(table, 1))
        return b.result(_bits(table, 2))

    found = known.unionByName(shared).unionByName(earlier).repartition(files, "file").groupBy("file").applyInArrow(third, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string")
    found = written(found.dropDuplicates(["digest"]), "suffix-found")
    marked = rows.join(copied, "digest", "left").withColumn("later", later)
    first = marked.where("NOT later").join(found, "digest").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    # a later copy: if it has a string of that length at all, each of its bytes is in one that the first copy has too
    gone = F.when(F.col("n_bytes") >= length, F.col("n_bytes")).otherwise(0).cast("bigint")
    spans, kept = (gone > 0).cast("bigint"), F.when(gone > 0, hashlib.sha256().hexdigest()).otherwise(F.lower(F.hex("digest")))
    return first.unionByName(marked.where("later").select("doc_id", "n_bytes", gone.alias("n_removed"), spans.alias("n_spans"), kept.alias("kept_sha256")))
