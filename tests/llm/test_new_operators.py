"""Suffix dedup, ranked search and clustering against brute force and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import clustering, lexical_search, suffix_dedup

DOCS = "doc_id bigint, text string, file string, term int, row bigint, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS).repartition(5)


def repeated(rows, length=50):
    rank = lambda i: (1 << 63) - 1 if i is None else i
    texts, first = [(i, (t or "").encode()) for i, t in rows], {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            first[s] = min(first.get(s := b[p : p + length], rank(i)), rank(i))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < rank(i):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone) if not y)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def bytes_case(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(r.choice([word() * r.randint(1, 4), r.choice(passages), r.choice(passages)[r.randint(0, 30) :]]) for _ in range(r.randint(0, 9)))
        rows.append((r.randint(0, 80), t))
    rows += [(7, None), (8, ""), (None, passages[0]), (None, passages[0]), (None, None), (500, "a" * 400), (499, "a" * 400), (3, "ab" * 300), (501, "ba" * 300), (502, "z" * 49), (503, "z" * 50), (504, "z" * 50), (505, rows[0][1]), (506, "".join(t for _, t in rows[:60]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_bytes(spark, seed):
    rows = bytes_case(seed)
    got = suffix_dedup.repeated_bytes(docs(spark, rows), block=3000, bucket=500)
    assert sorted(map(tuple, got.collect()), key=repr) == repeated(rows)


def test_repeated_bytes_of_other_lengths(spark):
    rows = bytes_case(3)
    got = suffix_dedup.repeated_bytes(docs(spark, rows), length=28, block=5000)
    assert sorted(map(tuple, got.collect()), key=repr) == repeated(rows, 28)
    with pytest.raises(ValueError):
        suffix_dedup.repeated_bytes(docs(spark, rows), length=20)


def test_keys_with_second_halves():
    """Equal first halves are told apart by the bytes that a wide key adds, in blocks and in a bucket's answer."""
    import pyarrow as pa

    keys, more = np.array([5, 5, 5, 9], np.uint64), np.array([3, 1, 3, 2], np.uint64)
    order = suffix_dedup._sorted(keys, more)
    assert list(zip(keys[order], more[order])) == [(5, 1), (5, 3), (5, 3), (9, 2)]
    a = suffix_dedup._lists("a", np.array([5, 9], np.uint64), 1, 32, np.array([1, 2], np.uint64), 2, np.array([10, 30]))
    b = suffix_dedup._lists("b", np.array([5, 9], np.uint64), 1, 32, np.array([3, 2], np.uint64), 2, np.array([20, 20]))
    got = suffix_dedup._answer(2, 2)(pa.Table.from_batches([a, b])).to_pylist()
    assert [np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), count=2).tolist() for r in got] == [[0, 1], [0, 0]]


def test_cover_is_a_difference_cover():
    steps = {(a - b) % suffix_dedup.MODULUS for a in suffix_dedup.COVER for b in suffix_dedup.COVER}
    assert steps == set(range(suffix_dedup.MODULUS))


def test_repeated_bytes_empty(spark):
    assert suffix_dedup.repeated_bytes(docs(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in suffix_dedup.repeated_bytes(docs(spark, [(1, "short"), (2, None)])).orderBy("doc_id").collect()] == [(1, 5, 0, 0), (2, 0, 0, 0)]


WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def cut(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(rows, items, k=10):
    counts = [(i, Counter(cut(t))) for i, t in rows]
    counts = [(i, c) for i, c in counts if c]
    N, L = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 25 + 75 * c.total() * N // L
            s = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in Counter(cut(text)).items() if c[t])
            scores.append((-s, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k]):
            out.append((item, rank + 1, i, -s))
    return sorted(out, key=repr)


@pytest.mark.parametrize("vocabulary", [lexical_search.VOCABULARY, 2000])
def test_search(spark, vocabulary):
    r = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "Éclair", "éclair", "naïve", "İx", "x1", "1", "of", "the", "the", "the", "a b", "c\x7fd", "e_f"] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    rows = [(i, text(r.randint(0, 40))) for i in range(150)] + [(300 + i, "the beta w1 same") for i in range(30)] + [(9, "the of"), (9, "the of"), (None, "w1 w2"), (None, None), (400, None), (401, "-- !"), (402, text(5000))]
    items = [(i, text(r.randint(0, 15))) for i in range(12)] + [(3, "the same"), (3, "the same"), (None, "w1"), (50, None), (51, ""), (52, "nowhere"), (53, "same same the")]
    frame = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id bigint, text string, q string")
    got = lexical_search.search(docs(spark, rows), frame, vocabulary=vocabulary)
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_empty_and_wide_numbers(spark, monkeypatch):
    items = spark.createDataFrame([(1, "the same")], "item_id bigint, text string")
    assert lexical_search.search(docs(spark, []), items).count() == 0
    assert lexical_search.search(docs(spark, [(1, "a")]), items.limit(0)).count() == 0
    assert lexical_search.search(docs(spark, [(1, None)]), items).count() == 0
    entries = spark.createDataFrame([(-1, 20, 10**17, 0, 1000), (0, 1, 1, 2, 100), (0, 2, 2, 1, 5)], lexical_search.POSTINGS)  # 75 * N * the longest passes a long
    assert {(r["row"], r["score"]) for r in lexical_search.scored_lists(entries).collect()} == {(i, math.floor(1000 * math.log(42 / 5)) * (10**9 * tf // (1000 * tf + 8 * (25 + 75 * n * 20 // 1000)))) for i, tf, n in ((1, 2, 100), (2, 1, 5))}


def clustered(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda x: hashlib.sha256(f"3:{'' if x[0] is None else x[0]}".encode()).hexdigest())[:k]
    c = [v for _, v in first]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c[i])), i) for i in range(len(c)))

    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[place(v)[1]].append(v)
        c = [[sum(x) // len(o) for x in zip(*o)] if o else c[i] for i, o in enumerate(own)]
    placed = [(i, *place(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, n, d in placed:
        each[n] += d
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, n, fit(d), fit(each[n]), fit(sum(each.values())), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in placed), key=repr)


@pytest.mark.parametrize(("far", "kind"), [(1.0, "float"), (1.0, "double"), (1e6, "double")])
def test_lloyd(spark, far, kind):
    r = random.Random(6)
    rows = [(i, [float(np.float32(r.gauss(i % 5, 1) * far)) for _ in range(64)]) for i in range(200)]
    rows += [(201, None), (202, [0.5] * 63), (203, [0.5] * 63 + [None]), (204, [0.5] * 63 + [float("nan")]), (205, [float("-inf")] * 64), (206, []), (None, [1.0] * 64), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, numbers int, cluster int").repartition(3)
    assert sorted(map(tuple, clustering.lloyd(df).collect()), key=repr) == clustered(rows)


def test_lloyd_few_and_overflowing(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert clustering.lloyd(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2e12] * 64)]  # a squared distance passes a long
    assert sorted(map(tuple, clustering.lloyd(spark.createDataFrame(rows, schema)).collect()), key=repr) == clustered(rows)
    rows = [(i, [v] * 64) for i, v in enumerate([0.0, 0.0, 0.0, 9.0, -9.0, 4e12, -4e12, 1e13, 5.0, 4e12, 1.0])]
    assert sorted(map(tuple, clustering.lloyd(spark.createDataFrame(rows, schema), k=4, rounds=2).collect()), key=repr) == clustered(rows, 4, 2)
    assert clustering.lloyd(spark.createDataFrame([(1, [1e30] * 64)], schema)).count() == 0
