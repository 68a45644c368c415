"""Shared folders, written tables and small column helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side is broadcast only when its measured rows, at its row width, stay under this.
BROADCAST_BYTES = 16 << 20


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`; only where that is unset and the master is local below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between the JVM and its workers; both hold a few at a time.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch size, so that memory for batches doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: What empties the caches of a worker process, and the work that filled them last.
CACHES: dict[str, Callable[[], None]] = {}
_last = ""


def enter(work: str) -> None:
    """Tells that this worker process now does `work`: caches that another kind of work left in it are emptied."""
    global _last
    if work != _last:
        for name, empty in CACHES.items():
            if name != work:
                empty()
        _last = work
        trim()


def trim() -> None:
    """Hands a worker's free memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: its lineage is cut and it outlives executors."""
    bounded_batches(df.sparkSession)
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder or file that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole(text: Column | str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def expected(df: DataFrame, rows: int, total: int, salt: str, *columns: str) -> DataFrame:
    """All of df's `total` rows if there are no more than `rows`; else those whose 64-bit hash of the columns is below rows / total of all hashes.

    About `rows` are expected, whatever the total.  Rows that are equal in all columns are in or out together.
    """
    if total <= rows:
        return df
    return df.where(F.xxhash64(F.lit(salt), *columns) < F.lit((rows << 64) // total - (1 << 63)))


def without(docs: DataFrame, dropped: DataFrame, repeats: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows whose (id, digest of the text as it stands) are in `dropped`; of the rows in `repeats` (same columns) one stays.

    dropped, repeats: columns key (id as string, null for null), digest (SHA-256, binary).
    """
    key, digest = fresh(docs, "row_key", "row_digest")
    marked = docs.withColumns({key: F.col(id_col).cast("string"), digest: row_digest(F.col(text_col))})

    def on(other: DataFrame):
        return marked[key].eqNullSafe(other["key"]) & (marked[digest] == other["digest"])

    left = marked.join(gone := small_side(dropped, 80), on(gone), "left_anti")
    if repeats is not None and repeats.limit(1).count():
        again = small_side(repeats, 80)
        once = marked.join(again, on(again), "left_semi").dropDuplicates([key, digest])
        marked = left
        left = left.join(again, on(again), "left_anti").unionByName(once)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def row_digest(text: Column) -> Column:
    """SHA-256 of a text as it stands; null's is that of nothing with a mark."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256))
