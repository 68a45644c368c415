"""The coverage cache: hits, stale and partial entries, two writers, half-written entries, and what a look-up reads."""

import re

import pytest

from loupe.operators import coverage_cache as cache

INPUTS, SOURCES, PIECES = "name string, item string, value string", "name string, item string", "name string, item string, value string"


@pytest.fixture()
def kept(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    inputs = spark.createDataFrame([("p", "a", "1"), ("p", "b", None), ("q", "support:c", "3"), ("r", "a", "1")], INPUTS)
    sources = spark.createDataFrame([("p", "x.py"), ("p", "y.py"), ("q", "x.py"), ("r", "z.py")], SOURCES)
    pieces = spark.createDataFrame([("p", "x.py", "1-3"), ("p", "x.py", "5-9"), ("q", "x.py", "1-1")], PIECES)
    cache.keep(spark, path, inputs, sources, pieces)
    return path, inputs, sources, pieces


def states(df):
    return {r["name"]: (r["state"], r["why"]) for r in df.collect()}


def test_hit_stale_partial_and_missing(spark, kept):
    path, inputs, sources, _ = kept
    rows = cache.read(spark, path, sources)
    served = cache.serve(rows, inputs, sources)
    assert states(served) == {n: ("served", None) for n in "pqr"}
    assert sorted(map(tuple, cache.pieces(rows, served).collect())) == [("p", "x.py", "1-3"), ("p", "x.py", "5-9"), ("q", "x.py", "1-1")]
    now = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2"), ("p", "d", "4"), ("q", "support:c", "9"), ("r", "a", "1"), ("new", "a", "1")], INPUTS)
    assert states(cache.serve(rows, now, sources.where("name <> 'r'"))) == {"p": ("changed", "b changed, d changed"), "q": ("changed", "c changed"), "r": ("also", "it also measured z.py"), "new": ("missing", None)}
    fewer = sources.where("item <> 'y.py'")
    assert states(cache.serve(rows, inputs, fewer))["p"] == ("also", "it also measured y.py") and states(cache.serve(rows, inputs, fewer, exact=False))["p"] == ("served", None)
    more = sources.union(spark.createDataFrame([("q", f"n{i}.py") for i in range(5)], SOURCES))
    assert states(cache.serve(rows, inputs, more))["q"] == ("unmeasured", "it measured no n0.py, n1.py, n2.py and 2 more")
    plans = spark.createDataFrame([("p", "g"), ("q", "g"), ("r", "h")], "name string, group string")
    assert {r["name"]: r["used"] for r in cache.serve_groups(cache.serve(rows, inputs, more), plans).collect()} == {"p": False, "q": False, "r": True}


def test_adding_to_an_entry_and_a_second_writer(spark, kept, tmp_path):
    path, inputs, sources, _ = kept
    rows = cache.read(spark, path, sources).where("name = 'p'")
    p = inputs.where("name = 'p'")
    cache.keep(spark, path, p, spark.createDataFrame([("p", "x.py"), ("p", "w.py")], SOURCES), spark.createDataFrame([("p", "x.py", "7-7")], PIECES), kept=rows)
    again = cache.read(spark, path, p)
    assert sorted(r["item"] for r in again.where("kind = 'sources'").collect()) == ["w.py", "x.py", "y.py"]
    assert [(r["item"], r["value"]) for r in again.where("kind = 'pieces'").collect()] == [("x.py", "7-7")]
    # two writers of one plan from the same state: the later whole entry counts, and neither is mixed with the other
    cache.keep(spark, path, p, sources.where("name = 'p'"), spark.createDataFrame([("p", "x.py", "first")], PIECES), kept=rows)
    cache.keep(spark, path, p, sources.where("name = 'p'"), spark.createDataFrame([("p", "x.py", "second")], PIECES), kept=rows)
    assert [r["value"] for r in cache.read(spark, path, p).where("kind = 'pieces'").collect()] == ["second"]
    # one that has not written all its rows yet isn't served
    half = spark.createDataFrame([("p", "later", "head", None, '{"rows":3,"digest":"x"}'), ("p", "later", "pieces", "x.py", "half")], "name string, entry string, kind string, item string, value string")
    half.selectExpr("name", "entry", "current_timestamp() AS at", "kind", "item", "value", f"cast(pmod(xxhash64(name), {cache.BUCKETS}) AS int) AS bucket").write.mode("append").partitionBy("bucket").parquet(path)
    assert [r["value"] for r in cache.read(spark, path, p).where("kind = 'pieces'").collect()] == ["second"]
    assert states(cache.serve(cache.read(spark, path, p), p, sources.where("name = 'p'"))) == {"p": ("served", None)}
    to = f"file://{tmp_path}/compact"
    cache.compact(spark, path, to)
    assert spark.read.parquet(to).where("kind = 'head'").count() == 3 and [r["value"] for r in cache.read(spark, to, p).where("kind = 'pieces'").collect()] == ["second"]


def test_a_look_up_reads_its_buckets_only(spark, kept, tmp_path):
    path, inputs, sources, _ = kept
    rows = cache.read(spark, path, sources.where("name = 'q'"))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", rows._jdf.queryExecution().toString())
    assert rows.select("bucket").distinct().count() == 1
    assert cache.read(spark, f"file://{tmp_path}/none", sources).count() == 0
    assert states(cache.serve(cache.read(spark, f"file://{tmp_path}/none", sources), inputs, sources)) == {n: ("missing", None) for n in "pqr"}
    assert cache.digests(inputs).count() == 3 and cache.digests(inputs.union(inputs)).exceptAll(cache.digests(inputs.orderBy("item"))).count() == 0
