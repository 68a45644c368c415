"""SimHash near-dedup by anchor-point covering.

A fingerprint's two halves are looked at apart: of two fingerprints that differ in at most 3 bits,
one half differs in at most 1.  The anchors of a half are the words of the [31, 26] Hamming code on 31
of its 32 bits: every point is within the covering radius 1 of exactly one anchor, its home.  So if a
and b differ in at most 1 bit there, b is within 1 + 1 of a's home.  Each distinct fingerprint is
replicated to all anchors within 2 (16 or fewer a half), and members of an anchor are compared with
those whose home it is, on all 64 bits.  An anchor gives a spanning forest of its links, not the
links themselves, so groups of near copies don't grow quadratically on the way out.

`near_copies` finds documents by their similarity instead: Jaccard >= 0.8 of five-word shingles.  It is an
exact prefix-filtered join: in one order of all shingles, those of rare ranges first, two texts that
similar share a shingle among the first fifth of each, and enough places are left after the first that
they share.  Texts that share a shingle there are its members.  Ranges of hashes are counted over all
texts; the counts only order shingles and never decide whether a pair is looked at.  Postings travel to owners of shingle ranges in compressed blocks, and
those of shingles that no other text has end there.  Pairs of a shingle with few members are all checked.
Of a larger one, some members represent it in a round: they are checked with all others, what is linked is
contracted, and the next round takes more representatives, for shingles with members in two
components; so a group of near copies costs its size times a few, and no link is lost.  A profile of each
set, which bounds what two can share, spares most pairs the check on whole texts.

Equal fingerprints are one point, so exact copies cost nothing beyond the first.  An anchor that more
than HOT_HOMES points have for their home is compared in several tasks.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words
than a shingle are one shingle; of components, the smallest id names them (null only if all are null).
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import BROADCAST_BYTES, bounded_batches, enter, row_digest, small_side, trim, without, written
from llm.components import components

SEED = 42
LIMIT = 3
#: Similarity search: the measure and the words of its shingles.
SIMILARITY, SHINGLE_WORDS = 0.8, 5
#: Ranges of hashes in which all texts' shingles are counted to order them by rarity, and pieces in which the counts travel.
RANGES, CHUNKS = 1 << 20, 16
#: Members of a shingle up to which its pairs are handed on at once, and of a larger one how many represent it in the first round; each further round takes GROWTH times as many.
SMALL_GROUP, FIRST, GROWTH = 8, 4, 16
#: Postings that a task sends at a time, that a task of owners is meant to get, and members of a shingle beyond which an owner doesn't hold them.
SENT_POSTINGS, OWNER_POSTINGS, HELD_MEMBERS = 1 << 19, 1 << 20, 4096
#: Ranges of a set's profile.
PROFILE = 256
#: Bytes of text cut into words at a time.
RUN_BYTES = 4 << 20
#: Rows of a comparison block, and homes of an anchor beyond which its comparison is split.
BLOCK, HOT_HOMES = 1 << 18, 4096
_SPACE = re.compile(rb"[ \t-\r]")


def word_runs(data: bytes, k: int):
    """Lists of words whose k-word shingles are, together, those of the text; each run starts with the k-1 words before it."""
    at, words = 0, []
    while at < len(data):
        end = len(data)
        if end - at > RUN_BYTES:
            m = _SPACE.search(data, at + RUN_BYTES)
            end = m.start() if m else end
        words += data[at:end].split()
        at = end
        if at >= len(data) or len(words) >= k:
            yield words
            words = words[len(words) - k + 1 :] if k > 1 and len(words) >= k else []


def fingerprint(text: str | None, k: int = 3) -> int:
    """64 bits: bit i is 1 if it is set in over half of the shingles' XXH64, repeats counted; 0 without words."""
    total, counts = 0, np.zeros(64, np.uint64)
    for words in word_runs((text or "").encode().lower(), k):
        hashes = _shingle_hashes(words, k)
        for i in range(0, len(hashes), 1 << 16):
            counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """(id, digest of the text as it stands, fp) of every row; fp is the fingerprint as a signed bigint."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), k) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["digest"], pa.array(prints)], names=["id", "digest", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), row_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, digest binary, fp bigint")


#: Column i of the Hamming code's check matrix is i + 1, so the syndrome of a word is the XOR of i + 1 over its bits.
def _syndromes(points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for i in range(31):
        out ^= ((points >> i) & 1) * (i + 1)
    return out


#: For each syndrome the bits to flip, in pairs as masks, that lead to the anchors at distance 2.
_PAIRS = [[(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < i ^ s] if s else [] for s in range(32)]


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of all anchors within 2 of each point; the points' bit 31 is not looked at."""
    points = half.astype(np.int64) & 0x7FFFFFFF
    syndrome = _syndromes(points)
    home = np.where(syndrome > 0, points ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), points)
    rows, found, homes = [np.arange(len(points))], [home], [np.ones(len(points), bool)]
    for s in range(1, 32):
        at = np.flatnonzero(syndrome == s)
        masks = np.array([m for m in _PAIRS[s] if m < 1 << 31], np.int64)
        rows.append(np.repeat(at, len(masks)))
        found.append((points[at][:, None] ^ masks).ravel())
        homes.append(np.zeros(len(at) * len(masks), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(homes)


def _replicate(batches):
    import pyarrow as pa

    for batch in batches:
        fp = batch["fp"].to_numpy()
        bits = fp.view(np.uint64)
        for side, half in enumerate((bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))):
            rows, found, homes = anchors(half)
            yield pa.RecordBatch.from_arrays([pa.array(found | (side << 32)), pa.array(homes), pa.array(fp[rows])], names=["anchor", "home", "fp"])


def forest(homes: np.ndarray, members: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links (distance <= limit) between homes and members of an anchor that connect all that its links connect."""
    label, out = np.arange(len(members)), []
    for a in homes:
        near = np.flatnonzero(np.bitwise_count(members ^ a) <= limit)
        labels, first = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            own = label[near[members[near] == a][0]]
            out += [(int(a), int(members[near[i]])) for l, i in zip(labels, first) if l != own]
            label[np.isin(label, labels)] = labels[0]
    return out


def _compare(limit: int):
    def run(batches):
        import pyarrow as pa

        def links(key, home, fp):
            edges = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
            sizes = np.diff(edges)
            has = np.add.reduceat(home.astype(np.int64), edges[:-1]) > 0
            out = []
            for g in np.flatnonzero((sizes > 1) & has):
                part = slice(edges[g], edges[g + 1])
                members = fp[part].view(np.uint64)
                out += forest(members[home[part]], members, limit)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append([batch[c].to_numpy(zero_copy_only=False) for c in ("anchor", "home", "fp")])
            rows += batch.num_rows
            if rows >= BLOCK:
                key, home, fp = (np.concatenate(x) for x in zip(*held))
                cut = np.searchsorted(key, key[-1])  # the last anchor may go on
                if cut:
                    yield links(key[:cut], home[:cut], fp[:cut])
                held, rows = [[key[cut:], home[cut:], fp[cut:]]], len(key) - cut
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held)))
        trim()

    return run


def _homes(batches):
    """The home anchors of both halves of each 64-bit point."""
    import pyarrow as pa

    for batch in batches:
        bits = batch["points"].to_numpy().view(np.uint64)
        for side, half in enumerate((bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))):
            points = half.astype(np.int64) & 0x7FFFFFFF
            syndrome = _syndromes(points)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(syndrome > 0, points ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), points) | (side << 32))], names=["anchor"])


def split_hot(replicas: DataFrame, points: DataFrame) -> DataFrame:
    """replicas with the comparison of anchors that many points have for their home dealt to several tasks.

    points: each point's fingerprint as a bigint.  Such an anchor's members are hashed into parts, and each part's
    homes meet all members; so every pair that would meet does, in one of the tasks.
    """
    counts = points.mapInArrow(_homes, "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n"))
    hot = written(counts.where(F.col("n") > HOT_HOMES).select("anchor", F.ceil(F.col("n") / HOT_HOMES).cast("bigint").alias("parts")), "simhash-hot")
    if hot.limit(1).count() == 0:
        return replicas
    rows = replicas.join(small_side(hot, 64), "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    rows, task = rows.withColumn("home", F.col("home") & (F.col("own") == F.col("other"))), F.col("other")
    return rows.withColumn("anchor", F.col("anchor") + task * (1 << 40)).select(*replicas.columns)


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect what all links within `limit` <= 3 bits connect."""
    if limit > 3:
        raise ValueError("the halves' radius covers 3 differing bits at most")
    replicas = prints.select("fp").mapInArrow(_replicate, "anchor bigint, home boolean, fp bigint")
    replicas = split_hot(replicas, prints.select(F.col("fp").alias("points")))
    n = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // 60_000))
    dealt = replicas.repartition(n, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_compare(limit), "a bigint, b bigint").distinct()


def _shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a run; of fewer words, of all of them."""
    from xxhash import xxh64_intdigest as h64

    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda x, y: x + y + 1))
    starts = [0, *(e + 1 for e in ends)]
    return np.array([h64(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :] or ends[-1:])], "<u8")


def distinct_shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted hashes of a text's k-word shingles, each once."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *(_shingle_hashes(run, k) for run in word_runs((text or "").encode().lower(), k))]))


def profile(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall into each of PROFILE equal ranges; 255 stands for that many or more."""
    ranges = (hashes >> np.uint64(64 - PROFILE.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(ranges, minlength=PROFILE), 255).astype(np.uint8).tobytes()


def range_ranks(times: np.ndarray) -> np.ndarray:
    """Two bytes for each count, in the counts' order; large counts that are nearly equal may share a rank."""
    return np.minimum(np.log2(1.0 + times) * 2047, 65535).astype(np.uint16)


def shingle_order(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """For each of RANGES ranges of shingle hashes a rank by how many (text, distinct shingle) fall into it, counted over all texts."""

    def count(batches):
        import pyarrow as pa

        times = np.zeros(RANGES, "<u4")
        for batch in batches:
            for t in batch["text"]:
                np.add.at(times, _range(distinct_shingles(t.as_py(), k)), 1)
        parts = times.reshape(CHUNKS, -1)
        # counts by their first bytes, second ones and so on: shuffles compress them better
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.view(np.uint8).reshape(-1, 4).T.tobytes() for p in parts], pa.binary())], names=["chunk", "times"])
        trim()

    def add(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for chunk, data in zip(batch["chunk"].to_pylist(), batch["times"]):
                times = np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()
                sums[chunk] = sums.get(chunk, 0) + times.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([range_ranks(x).tobytes() for x in sums.values()], pa.binary())], names=["chunk", "ranks"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "chunk int, times binary")
    rows = counted.repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, ranks binary").collect()
    return np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(r["ranks"], np.uint16) for r in sorted(rows, key=lambda r: r["chunk"]))]) if rows else np.zeros(RANGES, np.uint16)


def _range(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(RANGES - 1)).astype(np.int64)


def prefix(shingles: np.ndarray, order: np.ndarray, similarity: float) -> np.ndarray:
    """Those shingles, of rare ranges first, of which a text that similar has one at least."""
    n = len(shingles)
    return shingles[np.argsort(order[_range(shingles)], kind="stable")][: max(0, n - int(np.ceil(similarity * n - 1e-6)) + 1) if n else 0]


#: Bytes of a posting on the way to its owner: shingle, node, number of shingles of the node's text, place.
POSTING = np.dtype([("token", "<u8"), ("node", "<i8"), ("size", "<u4"), ("at", "<u4")])


def _planes(postings: np.ndarray) -> bytes:
    """The postings' first bytes, then all their second ones and so on: shuffles compress them better."""
    return postings.view(np.uint8).reshape(-1, POSTING.itemsize).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(POSTING.itemsize, -1).T).view(POSTING).ravel()


def _send(owners: int):
    """Rows of postings for each owner of a range of shingles, from rows (node, size, prefix)."""
    width = np.uint64(-(-(1 << 64) // owners))

    def run(batches):
        import pyarrow as pa

        def flush(parts):
            postings = np.concatenate(parts)
            postings = postings[np.argsort(postings["token"], kind="stable")]
            own = (postings["token"] // width).astype(np.int64)
            edges = _edges(own)
            sent = [_planes(postings[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(own[edges[:-1]]), pa.array(sent, pa.binary())], names=["owner", "postings"])

        held, rows = [], 0
        for batch in batches:
            lists = batch["prefix"]
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            part = np.zeros(int(lengths.sum()), POSTING)
            part["token"] = lists.flatten().to_numpy().view(np.uint64)
            part["node"] = np.repeat(batch["node"].to_numpy(), lengths)
            part["size"] = np.repeat(batch["size"].to_numpy(), lengths)
            part["at"] = np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            held.append(part)
            rows += len(part)
            if rows >= SENT_POSTINGS:
                yield flush(held)
                held, rows = [], 0
        if rows:
            yield flush(held)
        trim()

    return run


def _edges(key: np.ndarray) -> np.ndarray:
    """Where equal values of a sorted array begin, and its end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def may_be_similar(size_a, rest_a, size_b, rest_b, similarity: float):
    """Whether texts that share a shingle, with so many left from it on, may be that similar; for arrays and for columns."""
    need = similarity / (1 + similarity) * (size_a + size_b) - 1e-6
    return (rest_a >= need) & (rest_b >= need)


def _meet(similarity: float):
    """Of an owner's postings: pairs (node, other) of shingles with few members, and postings (other is null) of those with more.

    Postings of a shingle with over HELD_MEMBERS members are handed on as they come, so none is held whole.
    """

    def run(batches):
        import pyarrow as pa

        names, kinds = ["token", "node", "other", "size", "at"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

        def postings(rows):
            columns = [rows["token"].view(np.int64), rows["node"], None, rows["size"], rows["at"]]
            return pa.RecordBatch.from_arrays([pa.nulls(len(rows), k) if c is None else pa.array(np.ascontiguousarray(c).astype(k.to_pandas_dtype())) for c, k in zip(columns, kinds)], names=names)

        def pairs(rows):
            out, key = [np.zeros((0, 2), np.int64)], rows["token"]
            for d in range(1, SMALL_GROUP):
                a = np.flatnonzero(key[:-d] == key[d:])
                x, y = rows[a], rows[a + d]
                may = may_be_similar(x["size"].astype(np.int64), x["size"].astype(np.int64) - x["at"], y["size"].astype(np.int64), y["size"].astype(np.int64) - y["at"], similarity)
                out.append(np.stack([x["node"][may], y["node"][may]], 1))
            found = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            columns = [None, found[:, 0], found[:, 1], None, None]
            return pa.RecordBatch.from_arrays([pa.nulls(len(found), k) if c is None else pa.array(np.ascontiguousarray(c)) for c, k in zip(columns, kinds)], names=names)

        def grouped(held):
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["token"], kind="stable")]
            sizes = np.diff(_edges(rows["token"]))
            return rows, np.repeat(sizes, sizes)

        def done(held, open_):
            if held:
                rows, sizes = grouped(held)
                large = (sizes > SMALL_GROUP) | np.isin(rows["token"], open_)
                yield postings(rows[large])
                yield pairs(rows[~large & (sizes > 1)])

        owner, held, n, open_, most = None, [], 0, np.zeros(0, np.uint64), 4 * OWNER_POSTINGS
        for batch in batches:
            for own, data in zip(batch["owner"].to_pylist(), batch["postings"]):
                if own != owner:
                    yield from done(held, open_)
                    owner, held, n, open_, most = own, [], 0, np.zeros(0, np.uint64), 4 * OWNER_POSTINGS
                held.append(_from_planes(data.as_buffer()))
                n += len(held[-1])
                if n >= most:
                    rows, sizes = grouped(held)
                    open_ = np.union1d(open_, rows["token"][sizes > HELD_MEMBERS])
                    ready = np.isin(rows["token"], open_)
                    yield postings(rows[ready])
                    held, n = [rows[~ready]], int((~ready).sum())
                    most = max(4 * OWNER_POSTINGS, 2 * n)
        yield from done(held, open_)
        trim()

    return run


def by_representatives(large: DataFrame, roots: DataFrame, least: int, most: int, similarity: float) -> DataFrame | None:
    """Pairs (a, b) of a shingle's representatives and its other members, in different components, that may be that similar; None if no shingle has members in two.

    large: token, node, size, at and the shingle's number of members.  A shingle's representatives are those of its
    members whose place in a hash's order, of as many places as members, lies from `least` up to `most`; once `most` is
    the number of members, all have been one.  The members of a shingle are joined with its representatives, so
    a shingle that many texts share is split like any skewed key.
    """
    place = F.pmod(F.xxhash64("token", "node"), F.lit(1 << 30)) * F.col("members") / (1 << 30)
    rows = large.join(small_side(roots, 16), "node", "left").select("token", "node", "size", "at", place.alias("place"), F.coalesce("root", "node").alias("label"))
    apart = written(rows.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token"), "simhash-apart")
    if apart.limit(1).count() == 0:
        return None
    rows = written(rows.join(small_side(apart, 8), "token", "left_semi"), "simhash-members")
    chosen = rows.where((F.col("place") >= least) & (F.col("place") < most)).select("token", *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "at", "label")))
    may = may_be_similar(F.col("size_a"), F.col("size_a") - F.col("at_a"), F.col("size"), F.col("size") - F.col("at"), similarity)
    met = chosen.join(rows, (chosen["token"] == rows["token"]) & (F.col("label_a") != F.col("label")) & may)
    return met.select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes in different components."""
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    for end in ends:
        pairs = pairs.join(small_side(end, 16), end.columns[0], "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def close(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose profiles allow that similarity: shared shingles lie in the same range of both."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bound = np.zeros(batch.num_rows, np.int64)
            p, q = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, PROFILE) for c in ("profile_a", "profile_b"))
            bound = np.where((p == 255) & (q == 255), 1 << 40, np.minimum(p, q).astype(np.int64)).sum(axis=1)
            need = similarity / (1 + similarity) * (batch["size_a"].to_numpy().astype(np.int64) + batch["size_b"].to_numpy()) - 1e-6
            kept = batch.filter(pa.array(bound >= need))
            yield kept.select(["a", "b"])

    for c in ("a", "b"):
        side = rows.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("profile").alias(f"profile_{c}"))
        pairs = side.join(F.broadcast(pairs), c) if pairs.count() * (16 + PROFILE) <= BROADCAST_BYTES else pairs.join(side, c)
    return pairs.mapInArrow(run, "a bigint, b bigint")


def shingle_sets(nodes: DataFrame, rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, shingles) of the nodes, written."""
    wanted = written(rows.join(small_side(nodes, 8), "node", "left_semi").select("node", "id", F.col("digest").alias("sha")), "simhash-wanted")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [distinct_shingles(t.as_py(), k).view(np.int64) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])
        trim()

    texts = docs.select(F.col(id_col).cast("bigint").alias("i"), row_digest(F.col(text_col)).alias("d"), F.col(text_col).alias("text"))
    side = small_side(wanted, 64)
    found = texts.join(side, texts["i"].eqNullSafe(side["id"]) & (texts["d"] == side["sha"])).select("node", "text")
    return written(found.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"]), "simhash-sets")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets of shingles are that similar."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in ("a", "b"))
    held = sets.agg(F.sum(F.size("shingles") * 8 + 32)).first()[0] or 0
    if held <= BROADCAST_BYTES:
        left, right = F.broadcast(left), F.broadcast(right)
    both = F.size(F.array_intersect("sa", "sb"))
    # |A and B| / |A or B| >= similarity, without dividing
    return pairs.join(left, "a").join(right, "b").where(both * (1 + similarity) >= similarity * (F.size("sa") + F.size("sb")) - 1e-9).select("a", "b")


def near_copies(rows: DataFrame, known: DataFrame, docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, k: int = SHINGLE_WORDS) -> DataFrame:
    """(node, root) of the components of `known` links (a, b) and of all links between nodes of rows whose texts' k-word shingles are that similar.

    rows: node, id, digest, and of a text's shingles their digest (same), number (size), profile and prefix.
    """
    spark = rows.sparkSession
    firsts = rows.groupBy("same").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    same = written(rows.select("same", F.col("node").alias("b")).join(small_side(written(firsts, "simhash-firsts"), 64), "same").where("a < b").select("a", "b"), "simhash-same")
    points = rows.join(small_side(same.select(F.col("b").alias("node")), 16), "node", "left_anti")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(rows.agg(F.sum(F.size("prefix"))).first()[0] or 0) // OWNER_POSTINGS))
    sent = points.select("node", "size", "prefix").mapInArrow(_send(4 * n), "owner bigint, postings binary")
    met = written(sent.repartition(n, "owner").sortWithinPartitions("owner").mapInArrow(_meet(similarity), "token bigint, node bigint, other bigint, size int, at int"), "simhash-met")
    large = met.where("other IS NULL").select("token", "node", "size", "at")
    members = written(large.groupBy("token").agg(F.count("*").alias("members")), "simhash-tokens")
    largest = members.agg(F.max("members")).first()[0] or 0
    if largest:
        large = written(large.join(small_side(members, 16), "token"), "simhash-large")
    roots = written(components(known.union(same)), "simhash-roots")
    proposed, checked, sets, least, most = met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), None, None, 0, FIRST
    while True:
        chosen = by_representatives(large, roots, least, most, similarity) if largest else None
        pairs = proposed if chosen is None else chosen if proposed is None else proposed.union(chosen)
        if pairs is not None:
            pairs = apart(pairs.distinct(), roots)
            pairs = written(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"), "simhash-pairs")
            checked = pairs if checked is None else checked.union(pairs)
            pairs = written(close(pairs, rows, similarity), "simhash-close")
            nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            nodes = written(nodes if sets is None else nodes.join(sets.select("node"), "node", "left_anti"), "simhash-nodes")
            if nodes.limit(1).count():
                more = shingle_sets(nodes, rows, docs, id_col, text_col, k)
                sets = more if sets is None else sets.union(more)
            if pairs.limit(1).count():
                found = written(similar(pairs, sets, similarity), "simhash-similar")
                roots = written(components(roots.toDF("a", "b").union(found)), "simhash-roots")
        if chosen is None or most >= largest:
            return roots
        proposed, least, most = None, most, most * GROWTH


def _components(rows: DataFrame, limit: int) -> DataFrame:
    """rows (id, digest, fp) with component_id."""
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-prints")
    roots = written(components(links(prints, limit)), "simhash-roots")
    named = roots.join(prints, roots["node"] == prints["fp"]).groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = roots.join(named, "root").select("node", F.col("component_id").alias("linked_id"))
    own = prints.join(linked, prints["fp"] == linked["node"], "left").select("fp", F.when(F.col("node").isNotNull(), F.col("linked_id")).otherwise(F.col("first_id")).alias("component_id"))
    return rows.join(written(own, "simhash-components"), "fp")


def _components_by_similarity(docs: DataFrame, id_col: str, text_col: str, k: int, limit: int, similarity: float) -> DataFrame:
    """(id, digest, fp, component_id) of every row, by fingerprint links and links by similarity together."""

    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(shingle_order(docs, text_col, SHINGLE_WORDS))

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        enter("simhash")
        for batch in batches:
            texts = [t.as_py() for t in batch["text"]]
            prints = np.array([fingerprint(t, k) for t in texts], np.uint64).view(np.int64)
            sets = [distinct_shingles(t, SHINGLE_WORDS) for t in texts]
            prefixes = pa.array([prefix(x, shared.value, similarity).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["digest"], pa.array(prints), pa.array([xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(map(profile, sets), pa.binary()), prefixes], names=["id", "digest", "fp", "same", "size", "profile", "prefix"])
        trim()

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), row_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text"))
    rows = written(source.mapInArrow(run, "id bigint, digest binary, fp bigint, same binary, size int, profile binary, prefix array<bigint>").withColumn("node", F.monotonically_increasing_id()), "simhash-wide")
    own = written(rows.groupBy("fp").agg(F.min("node").alias("first")), "simhash-firsts")
    by_print = links(own.select("fp"), limit)
    a, b = (own.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}")) for c in ("a", "b"))
    joined = by_print.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    equal = rows.join(own, "fp").where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b"))
    roots = written(near_copies(rows, joined.union(equal), docs, id_col, text_col, similarity), "simhash-roots")
    placed = written(rows.select("node", "id", "digest", "fp").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "simhash-placed")
    named = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(named, "root").select("id", "digest", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = written(fingerprints(docs, id_col, text_col, k), "simhash-rows")
    return _components(rows, limit).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, limit: int = LIMIT, similarity: float | None = None) -> DataFrame:
    """docs, all columns, with one row of each component: of those with its smallest id, the one with the smallest digest.

    Components are those of fingerprint links; with a similarity, also of links by that similarity.
    """
    if similarity is None:
        rows = _components(written(fingerprints(docs, id_col, text_col, k), "simhash-rows"), limit)
    else:
        rows = _components_by_similarity(docs, id_col, text_col, k, limit, similarity)
    rows = written(rows, "simhash-labelled")
    keepers = rows.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy(F.col("component_id").alias("keep_id"), "digest").agg(F.count("*").alias("n"))
    keepers = keepers.groupBy("keep_id").agg(F.min(F.struct("digest", "n")).alias("keep"))
    shared = rows.groupBy("component_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    shared = written(shared.join(keepers, shared["component_id"].eqNullSafe(keepers["keep_id"])).select(F.col("component_id").alias("cid"), "keep.digest", "keep.n"), "simhash-keepers")
    kept = F.col("id").eqNullSafe(F.col("cid")) & (rows["digest"] == shared["digest"])
    dropped = written(rows.join(shared, rows["component_id"].eqNullSafe(shared["cid"])).where(~kept).select(F.col("id").cast("string").alias("key"), rows["digest"]).distinct(), "simhash-dropped")
    repeats = shared.where("n > 1").select(F.col("cid").cast("string").alias("key"), "digest")
    return without(docs, dropped, repeats, id_col, text_col)
