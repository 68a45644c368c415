"""Live results: rebuild when sources change, and windowed counts over event streams."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds between looks at the sources, and after which a quiet reader is told that its connection holds (fixed values).
INTERVAL, KEEP_ALIVE = 0.5, 15.0
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def signature(files: DataFrame) -> str:
    """A digest of (path, stamp) rows, whatever their order; equal digests mean nothing changed."""
    row = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "stamp").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['s']}"


class Versions:
    """The newest result that was built: a build that fails keeps the one before."""

    def __init__(self, build: Callable[[DataFrame], DataFrame]):
        self.build, self.version, self.result, self.seen, self.error = build, 0, None, None, None

    def poll(self, files: DataFrame) -> bool:
        """Rebuilds if the files changed since the last poll; whether there is a new version."""
        now = signature(files)
        if now == self.seen:
            return False
        self.seen = now
        try:
            self.result, self.error = self.build(files), None
        except Exception as e:  # the old version stays, with the reason
            self.error = str(e)
            return False
        self.version += 1
        return True


def watch(versions: Versions, files: Callable[[], DataFrame], stop: threading.Event, interval: float = INTERVAL, changed: Callable[[int], None] | None = None) -> None:
    """Looks at files() every interval until stop is set and tells of each new version; what fails is looked at again, and the last good version stays."""
    while not stop.wait(interval):
        try:
            new = versions.poll(files())
        except Exception as e:  # the sources couldn't be listed: they may be by the next look
            versions.error = str(e)
            continue
        if new and changed is not None:
            changed(versions.version)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Events in tumbling windows by key; on a stream, later ones than the watermark are dropped."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(F.window("ts", size), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), key, "n")


class _FileStates(StatefulProcessor):
    """The newest stamp and digest of one path; a timer takes a path that was quiet for `idle` milliseconds of event time out of the state."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "stamp bigint, digest string, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        old = self.newest.get() if self.newest.exists() else None
        stamp, digest, seen = old if old is not None else (None, None, 0)
        for batch in rows:
            for s, d, ms in zip(batch["stamp"], batch["digest"], batch["ms"], strict=True):
                d = None if pd.isna(d) else d
                seen = max(seen, int(ms))
                if stamp is None or (int(s), d is not None, d or "") > (stamp, digest is not None, digest or ""):
                    stamp, digest = int(s), d
        self.newest.update((stamp, digest, seen))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(seen + self.idle)
        before = old[1] if old is not None else None
        if digest != before:
            yield self.row(key, stamp, "gone" if digest is None else "new" if before is None else "changed")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        stamp, digest, _ = self.newest.get()
        self.newest.clear()
        if digest is not None:
            yield self.row(key, stamp, "evicted")

    def row(self, key, stamp: int, change: str) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "stamp": [stamp], "change": [change]})

    def close(self) -> None:
        pass


def file_changes(stream: DataFrame, idle: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(path, stamp, change) of a stream of file states (path, stamp, digest, ts): new, changed, gone (a NULL digest) or evicted.

    State is kept by path and holds a stamp and a digest, no text.  A state as old as the last one or older changes nothing; of equal
    stamps the larger digest counts, and any digest counts more than NULL.  A path is evicted when the watermark is `idle` past its last row; one that
    was gone leaves silently, and one that comes back later is new.  Rows without a path, stamp or ts are no states and are left out.
    Timers need the RocksDB state store: it becomes the session's where no other is set.
    """
    spark = stream.sparkSession
    if PROVIDER not in spark.conf.getAll:
        spark.conf.set(PROVIDER, ROCKS)
    length = spark.range(1).select(F.expr(f"cast(INTERVAL '{idle}' AS INTERVAL DAY TO SECOND)").alias("i")).first()["i"]
    rows = stream.where("path IS NOT NULL AND stamp IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("path", F.col("stamp").cast("bigint").alias("stamp"), "digest", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("path").transformWithStateInPandas(_FileStates(int(length.total_seconds() * 1000)), "path string, stamp bigint, change string", "Update", "EventTime")


def latest_by_file(stream: DataFrame, store: str, checkpoint: str, key: str = "path"):
    """Keeps the newest row of each key of a stream of file states as a table below store, one version a batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "stamp").alias("r")).select("r.*")
        if number:
            old = spark.read.parquet(f"{store}/version={number - 1}")
            newest = newest.unionByName(old.join(newest.select(key), key, "left_anti"))
        newest.write.mode("overwrite").parquet(f"{store}/version={number}")
        announce(spark, store, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _announced(store: str) -> str:
    return f"{store.rstrip('/')}-announced"


def announce(spark: SparkSession, store: str, version: int) -> None:
    """Says that a version of a store is whole; to say it again, as a batch does that runs anew, changes nothing."""
    spark.range(1).select(F.lit(version).cast("bigint").alias("version")).coalesce(1).write.mode("append").parquet(_announced(store))


class Reader:
    """Reads a store's versions at its own pace: always the newest whole one, and never one twice; those between are passed over."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store, self.seen = spark, store, None

    def newest(self) -> int | None:
        try:
            return self.spark.read.schema("version bigint").parquet(_announced(self.store)).agg(F.max("version")).first()[0]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":  # nothing was announced yet
                return None
            raise

    def next(self) -> tuple[int, DataFrame] | None:
        """The newest version and its rows if it is newer than the last one this reader got, else None."""
        version = self.newest()
        if version is None or (self.seen is not None and version <= self.seen):
            return None
        self.seen = version
        return version, self.spark.read.parquet(f"{self.store}/version={version}")


def deliver(reader: Reader, send: Callable[[int | None], None], stop: threading.Event, interval: float = INTERVAL, keep_alive: float = KEEP_ALIVE) -> None:
    """Sends the version at once and then each newer one, until stop is set; None after every `keep_alive` seconds without one.

    The reader looks again only after send returns, so a slow receiver gets the newest version next and no backlog.
    """
    told = time.monotonic()
    while not stop.is_set():
        found = reader.next()
        if found is not None or time.monotonic() - told >= keep_alive:
            send(found[0] if found is not None else None)
            told = time.monotonic()
        stop.wait(interval)
