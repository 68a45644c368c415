"""Keyed state with eviction, polling, and delivery of the newest version."""

import threading

from loupe.streaming import live

STATES = "path string, stamp long, digest string, t string"


def test_file_changes_evict_and_restart(spark, tmp_path):
    source, check, out = (str(tmp_path / x) for x in ("in", "check", "out"))

    def run(name, rows):
        spark.createDataFrame(rows, STATES).selectExpr("path", "stamp", "digest", "cast(t AS timestamp) AS ts").coalesce(1).write.parquet(f"{source}/{name}")
        stream = spark.readStream.schema("path string, stamp long, digest string, ts timestamp").parquet(f"{source}/*")
        changes = live.file_changes(stream, idle="2 hours", late="0 seconds")
        kept = []

        def keep(batch, number):
            batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/{name}/{number}")
            kept.extend(tuple(r) for r in batch.collect())

        changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(kept, key=repr)

    day = "2024-01-01 "
    # states within a batch: the newest counts; a row without a path is no state
    assert run("1", [("a", 1, "x", day + "00:00:00"), ("a", 2, "y", day + "00:00:00"), ("b", 1, "z", day + "00:30:00"), ("c", 5, "c", day + "00:30:00"), (None, 1, "n", day + "00:30:00")]) == [("a", 2, "new"), ("b", 1, "new"), ("c", 5, "new")]
    # every run is a query of its own that goes on from the checkpoint: the same state, an older one, a change, and one that is gone
    assert run("2", [("a", 2, "y", day + "01:00:00"), ("a", 1, "x", day + "01:00:00"), ("b", 2, "zz", day + "01:00:00"), ("c", 6, None, day + "01:00:00")]) == [("b", 2, "changed"), ("c", 6, "gone")]
    # two hours after their last rows b and c leave, c silently, as nothing of it was left; a was seen since
    assert run("3", [("a", 3, "y", day + "02:30:00"), ("d", 1, "d", day + "03:30:00")]) == [("b", 2, "evicted"), ("d", 1, "new")]
    # an evicted path is new again
    assert run("4", [("b", 2, "zz", day + "04:00:00")]) == [("b", 2, "new")]


def test_watch_polls_and_keeps_the_last_good_build(spark):
    files = [spark.createDataFrame([("a", s)], "path string, stamp string") for s in "123"]
    looks, told, stop = [], [], threading.Event()

    def listing():
        looks.append(1)
        if len(looks) == 2:
            raise OSError("no listing")
        if len(looks) == 6:
            stop.set()
        return files[min(len(looks) // 2, 2)]

    def build(f):
        if f.first()["stamp"] == "2":
            raise ValueError("caught mid-save")
        return f.first()["stamp"]

    versions = live.Versions(build)
    live.watch(versions, listing, stop, 0.01, told.append)
    assert told == [1, 2] and versions.result == "3" and versions.error is None


def test_a_slow_reader_gets_the_newest_version_only(spark, tmp_path):
    store = str(tmp_path / "store")
    reader, slow = live.Reader(spark, store), live.Reader(spark, store)
    assert reader.next() is None

    def write(n):
        spark.range(n).write.mode("overwrite").parquet(f"{store}/version={n}")

    write(1)
    assert reader.next() is None  # written, but not whole until it is announced
    live.announce(spark, store, 1)
    version, rows = reader.next()
    assert version == 1 and rows.count() == 1 and reader.next() is None
    for n in (2, 3, 3):
        write(n)
        live.announce(spark, store, n)
    assert slow.next()[0] == 3 and slow.next() is None and reader.next()[0] == 3

    sent, stop = [], threading.Event()

    def send(version):
        sent.append(version)
        if version == 3:  # two versions come while this receiver is busy
            for n in (4, 5):
                write(n)
                live.announce(spark, store, n)
        if version is None:
            stop.set()

    live.deliver(live.Reader(spark, store), send, stop, 0.01, 0.0)
    assert sent == [3, 5, None]
