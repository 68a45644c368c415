"""The entry points, the stream and the catalogue's oracles on the smallest tables."""

import importlib
import sys

import duckdb
import pytest

import __spark_entry__
from loupe.plans import catalogue
from loupe.streaming import live

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(monkeypatch):
    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name.split(".")[0] in ("llm", "corpus_pipeline"):
                raise ModuleNotFoundError(name)

    monkeypatch.setattr(importlib.util, "find_spec", lambda name, package=None: None if name in ("llm", "corpus_pipeline") else True)
    for name in [m for m in sys.modules if m.split(".")[0] in ("llm", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    assert __spark_entry__.queries() == catalogue.QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", [n for n in catalogue.ORACLES if n not in ("q_scc", "q_dry_groups", "q_dry_focus")])
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_versions_keep_the_last_good_build(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, stamp string")
    calls = []

    def build(f):
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("broken")
        return f.count()

    v = live.Versions(build)
    assert v.poll(files) and not v.poll(files.orderBy("path", ascending=False)) and v.version == 1 and v.result == 2
    changed = files.withColumn("stamp", files["path"])
    assert not v.poll(changed) and v.result == 2 and "broken" in v.error
    assert v.poll(files) and v.version == 2


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", tmp_path / "store"
    rows = lambda x: spark.createDataFrame(x, "path string, stamp long, body string")
    rows([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]).coalesce(1).write.parquet(str(source / "1"))
    stream = lambda: spark.readStream.schema("path string, stamp long, body string").parquet(f"{source}/*")
    live.latest_by_file(stream(), str(store), str(tmp_path / "check")).awaitTermination(60)
    rows([("b", 3, "new")]).coalesce(1).write.parquet(str(source / "2"))
    live.latest_by_file(stream(), str(store), str(tmp_path / "check")).awaitTermination(60)
    assert sorted((r["path"], r["body"]) for r in spark.read.parquet(f"{store}/version=1").collect()) == [("a", "y"), ("b", "new")]


def test_stream_windows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = live.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]
