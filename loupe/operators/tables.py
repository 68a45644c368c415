"""Shared folders, and cutting lineage in iterative operators."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows, at their width, stay under this.
BROADCAST_BYTES = 16 << 20


def cut(df: DataFrame) -> DataFrame:
    """df as checkpointed in the folder of spark.checkpoint.dir; only where that is unset and the master is local in a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


@functools.cache
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tables-")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`; only where that is unset and the master is local below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _own()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
