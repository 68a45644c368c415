"""Best-fit packing by a configuration linear program over the length histogram.

Every document's ids, with an end id, are cut into pieces of at most `size` ids.  A configuration is a
multiset of piece lengths that fits a sequence; the program asks for the fewest configurations that
cover the histogram.  It is solved by multiplicative weights: each length has a weight that falls as
the length is covered, a knapsack dynamic program prices the best configurations for those weights,
and each gets a share, in whole times, of what its lengths lack.  It runs until at most TOLERANCE of the
ids are open; those are placed best fit, longest first.

Only the histogram (at most `size` numbers) comes to the driver.  Pieces are numbered within their
length by counts of tasks added up over tasks, and a table of places, bounded by the histogram, turns
length and number into sequence and offset, so no group of pieces is gathered anywhere.

Edge cases: null and empty texts have the end id alone; repeated rows are packed each; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import tokens
from llm.common import small_side, trim, whole, written

TOKENIZER, END_ID, SIZE = "byte_bpe_50k.json", 0, 2048
#: Share of a configuration's whole possible use that one step of the weights gives it, how fast weights fall, and the share of ids that the program may leave open.
STEP, RATE, TOLERANCE = 0.5, 1.0, 0.01
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, src bigint, nth bigint"


def knapsack_choices(values: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """For each room up to size, the length number that the configuration of most value takes next; -1: none, try one id less.

    An unbounded dynamic program over sizes; lengths go up.
    """
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    ends = np.searchsorted(lengths, np.arange(size + 1), "right")
    for room in range(1, size + 1):
        if n := ends[room]:
            gain = best[room - lengths[:n]] + values[:n]
            i = int(gain.argmax())
            if gain[i] > best[room - 1]:
                best[room], choice[room] = gain[i], i
                continue
        best[room] = best[room - 1]
    return choice


def filled(used: dict[int, int], lengths: np.ndarray, limits: np.ndarray, size: int) -> dict[int, int]:
    """The configuration with what room it leaves filled, longest first, within the limits."""
    used, free = dict(used), limits.copy()
    for i, n in used.items():
        free[i] -= n
    left = size - sum(int(lengths[i]) * n for i, n in used.items())
    while len(fit := np.flatnonzero(free[: np.searchsorted(lengths, left, "right")])):
        i = int(fit[-1])
        n = min(left // int(lengths[i]), int(free[i]))
        used[i] = used.get(i, 0) + n
        free[i] -= n
        left -= n * int(lengths[i])
    return used


def with_length(i: int, room_left: int, choice: np.ndarray, lengths: np.ndarray, limits: np.ndarray) -> dict[int, int]:
    """Length i and the configuration of most value beside it, by a knapsack's choices; a length beyond its limit is cut back."""
    used, room = {i: 1}, room_left
    while room > 0:
        c = int(choice[room])
        if c < 0:
            room -= 1
            continue
        used[c] = used.get(c, 0) + 1
        room -= int(lengths[c])
    return {c: n for c, m in used.items() if (n := min(m, int(limits[c]))) > 0}


def solve(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """The covering program: (configuration, whole times), by multiplicative weights, until TOLERANCE of the ids or less is open.

    A length's price is its share of a sequence times its weight; each use of a configuration lowers the
    weights of its lengths by the share of them that it covers, so lengths that are hard to place gain.  One
    knapsack prices a phase: for each open length, longest first, the best configuration that holds it.  The
    number of phases follows the logarithm of the counts: a phase takes a share of each open length.
    """
    lack, weights, out = counts.astype(np.int64), np.ones(len(lengths)), []
    least = TOLERANCE * float(lengths @ lack)
    while float(lengths @ lack) > least:
        open_ = np.flatnonzero(lack)
        own = lengths[open_]
        choice = knapsack_choices((weights[open_] / weights[open_].max()) ** RATE * own / size, own, size)
        for k in range(len(open_) - 1, -1, -1):
            if not lack[open_[k]]:
                continue
            config = {int(open_[c]): n for c, n in with_length(k, size - int(own[k]), choice, own, lack[open_]).items()}
            config = filled(config, lengths, lack, size)
            times = max(1, int(min(lack[i] // n for i, n in config.items()) * STEP))
            for i, n in config.items():
                weights[i] *= 1 - n * times / lack[i]
                lack[i] -= n * times
            out.append((config, times))
        weights = np.maximum(weights, 1e-9)
    return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, size: int = SIZE) -> dict[tuple[tuple[int, int], ...], int]:
    """What is left of the histogram, longest first, each into the fullest sequence with room: configuration -> times.

    Sequences with equal content are handled together, so the work follows the histogram and not the pieces.
    """
    rooms: list[dict[tuple, int]] = [{} for _ in range(size + 1)]
    some = np.zeros(size + 1, bool)

    def put(room: int, held: tuple, times: int) -> None:
        if times:
            rooms[room][held] = rooms[room].get(held, 0) + times
            some[room] = True

    for i in map(int, np.argsort(-lengths, kind="stable")):
        n, c = int(lengths[i]), int(counts[i])
        while c:
            room = n + int(some[n:].argmax())
            if some[room]:
                held, times = rooms[room].popitem()
                some[room] = bool(rooms[room])
                fit = min(room // n, c)
                k = min(times, c // fit)
                put(room, held, times - k)
                put(room - fit * n, (*held, (i, fit)), k)
                c -= k * fit
            else:
                fit = min(size // n, c)
                put(size - fit * n, ((i, fit),), c // fit)
                c %= fit
    out: dict[tuple[tuple[int, int], ...], int] = {}
    for held, times in (x for group in rooms for x in group.items()):
        key = tuple(sorted(held))
        out[key] = out.get(key, 0) + times
    return out


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """(configuration as length -> times in it, whole times) that hold exactly the histogram's pieces."""
    full = histogram.get(size, 0)
    lengths = np.array(sorted(n for n in histogram if n < size), np.int64)
    counts = np.array([histogram[n] for n in lengths], np.int64)
    whole_times: dict[tuple[tuple[int, int], ...], int] = {}
    left = counts.copy()
    if len(lengths):
        for config, n in solve(lengths, counts, size):
            key = tuple(sorted(config.items()))
            whole_times[key] = whole_times.get(key, 0) + n
            for i, m in config.items():
                left[i] -= m * n
        for key, n in best_fit(lengths, left, size).items():
            whole_times[key] = whole_times.get(key, 0) + n
    out = [({int(lengths[i]): m for i, m in key}, n) for key, n in whole_times.items()]
    return out + ([({size: 1}, full)] if full else [])


def places(configs: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, pieces a sequence, first sequence, first offset) in order of the first number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for config, times in configs:
        offset = 0
        for length, m in sorted(config.items(), reverse=True):
            rows.setdefault(length, []).append((taken.get(length, 0), m, sequence, offset))
            taken[length] = taken.get(length, 0) + m * times
            offset += m * length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def cut(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, written: of a document longer than size, all but the first have that many ids.

    src and nth: the task that cut a piece, and how many pieces of its length that task cut before.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        src, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), tokens.encoder(tokenizer).encode(t.as_py() for t in batch["text"])):
                ids += end
                n = len(ids) // 4
                at = piece = 0
                while at < n:
                    length = size if piece else (n - 1) % size + 1
                    rows.append((doc, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), src, int(seen[length])))
                    seen[length] += 1
                    at += length
                    piece += 1
                if len(rows) >= 1 << 16:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
        trim()

    def _batch(rows):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "src", "nth"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    return written(rows.mapInArrow(run, PIECES), "packing-pieces")


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, size: int = SIZE, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = cut(docs, tokenizer, end_id, size, **columns)
    counts = written(pieces.groupBy("src", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, size)))
    before = counts.select("src", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                at, rows = np.flatnonzero(lengths == length), shared.value[int(length)]
                first, times, base, start = rows[np.searchsorted(rows[:, 0], number[at], "right") - 1].T
                sequence[at] = base + (number[at] - first) // times
                offset[at] = start + (number[at] - first) % times * length
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = pieces.join(small_side(before, 80), ["src", "length"]).select(*names, (F.col("nth") + F.col("before")).alias("number"))
    return numbered.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
