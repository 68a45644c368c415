"""Samples keep to their bound at any size, and none is empty by rounding."""

import random

import numpy as np
import pytest

from llm import language_id, simhash
from llm.common import expected


def test_share_of_a_thousand_millionth(spark):
    df = spark.range(1_000_000).selectExpr("id AS doc_id", "concat('t', id) AS text")
    # stubbed totals: the rows seen are a part of a table of that many
    assert 800 < expected(df, 1_000, 1_000_000, "fit", "doc_id", "text").count() < 1_200
    assert expected(df, 1_000_000, 1_000_000, "fit", "doc_id", "text").count() == 1_000_000
    plan = expected(df, 200, 200_000_000_000, "fit", "doc_id", "text")  # a share of 10^-9: a threshold of its own, not 0
    low, high = (expected(df, 200, total, "fit", "doc_id", "text").count() for total in (200_000_000_000, 2_000_000))
    assert low <= 2 and 50 < high < 150 and str((200 << 64) // 200_000_000_000 - (1 << 63)) in plan._jdf.queryExecution().toString()


def test_null_ids_keep_the_bound(spark):
    df = spark.range(20_000).selectExpr("cast(NULL AS bigint) AS doc_id", "concat('some words ', id) AS text", "CASE id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS lang")
    assert 700 < expected(df, 1_000, 20_000, "fit", "doc_id", "text").count() < 1_300
    langs, matrix = language_id.fit(df, train_rows=500)
    assert langs == ["a", "b"]


def test_three_hundred_languages(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdefghij") for _ in range(3)) * 5, f"l{i % 300:03d}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="most_languages"):
        language_id.fit(df)
    langs, matrix = language_id.fit(df, most_languages=300)
    assert len(langs) == 300 and matrix.shape == (language_id.BUCKETS + 1, 300)


def test_shingles_are_ordered_by_counts_of_all_texts(spark):
    texts = [f"one two three four five w{i} w{i % 7}" for i in range(12_000)] + [None, "", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    times = np.zeros(simhash.RANGES, np.int64)
    for t in texts:
        np.add.at(times, (simhash.distinct_shingles(t, 5) & np.uint64(simhash.RANGES - 1)).astype(int), 1)
    got = simhash.shingle_order(docs, "text", 5)
    assert times.max() >= 12_000 and (got == simhash.range_ranks(times)).all()
    assert len(simhash.shingle_order(docs.limit(0), "text", 5)) == simhash.RANGES
    shared = simhash.distinct_shingles("one two three four five", 5)[0]
    # a shingle that every text has comes last in its order
    assert shared not in simhash.prefix(simhash.distinct_shingles(texts[5], 5), got, 0.8)
