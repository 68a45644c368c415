"""Centroid clustering: plain Lloyd rounds in exact integers.

1. `components` keeps vectors of `size` components, none null or non-finite, and turns each x into the integer
   floor(scale * x), x as double.  The integers are a written table, so each round reads them and nothing else.
2. Centroids start as the k kept vectors whose SHA-256 of `seed:vec_id` is smallest, in that order.
3. In each round tasks hold the k centroids (k * size numbers, whatever the table's size), take squared differences
   to each centroid in NumPy, and give the lowest of the nearest to `argmin`.  A task sends one sum and one count for
   each centroid and component, as decimals that can't overflow; `groupBy` merges them.  The new centroid is the
   exact floor(sum / count); a centroid without vectors stays.
4. After the rounds every vector is assigned once more.

Edge cases: fewer kept vectors than k give as many centroids; an empty table gives an empty result.  A null vec_id is
hashed as `seed:`; of equal hashes the vector with smaller components comes first, and equal vectors are one centroid each.
A vector with an integer that a long can't hold isn't kept.  Where a squared distance could pass a long, it is
computed in Python's integers: the assignment stays exact, and a distance or inertia over a long is null.  Other columns are
never read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import written

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: With magnitudes up to this, 64 squared differences fit in a long many times over.
SMALL = 1 << 26
LONG = (1 << 63) - 1


def kept(vector: Column, size: int = SIZE, scale: int = SCALE) -> Column:
    """Whether a vector counts: `size` components, none null or non-finite, each within a long after scaling."""
    fits = lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float(1 << 63))  # noqa: E731  NaN ranks above all numbers
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, fits)


def components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and `numbers`, the integers of each kept vector as little-endian 64-bit integers; written to the shared folder."""

    vector, name = F.col(vector_col), F.col(id_col).cast("bigint")
    rows = vectors.where(kept(vector, size, scale)).select(F.coalesce(name, F.lit(0)).alias("vec_id"), name.isNull().alias("no_id"), F.transform(vector, lambda x: x.cast("double")).alias("x"))

    def run(frames):
        for f in frames:
            if len(f):
                x = np.floor(np.stack(f["x"].to_numpy()) * scale).astype("<i8")
                yield f[["vec_id", "no_id"]].assign(numbers=[row.tobytes() for row in x])

    return written(rows.mapInPandas(run, "vec_id bigint, no_id boolean, numbers binary"), "cluster-numbers")


def _unpack(numbers, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(numbers), "<i8").reshape(-1, size)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number.  Python's integers where a long could overflow."""
    most = max(max((abs(c) for row in centroids for c in row), default=0), int(np.abs(x.astype(np.float64)).max(initial=0)))
    exact = most >= SMALL or x.shape[1] > 256
    x = x.astype(object) if exact else x
    each = np.empty((len(x), len(centroids)), object if exact else np.int64)
    for i, centroid in enumerate(centroids):
        gaps = x - np.array(centroid, object if exact else np.int64)
        each[:, i] = (gaps * gaps).sum(axis=1) if exact else np.einsum("ij,ij->i", gaps, gaps)
    best = each.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return best, each[np.arange(len(x)), best]


def start(numbers: DataFrame, k: int = CLUSTERS, size: int = SIZE, seed: int = SEED) -> list[list[int]]:
    """The first centroids: k rows at most come to the driver."""
    name = F.when(F.col("no_id"), F.lit(f"{seed}:")).otherwise(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")))
    first = numbers.withColumn("h", F.sha2(name, 256)).orderBy("h", "numbers").limit(k).select("numbers").collect()
    return [_unpack([r["numbers"]], size)[0].tolist() for r in first]


def step(numbers: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; k * size sums and counts come to the driver."""
    k, size = len(centroids), len(centroids[0])

    def run(frames):
        import pandas as pd

        sums, counts = np.zeros((k, size), object), np.zeros(k, np.int64)
        for f in frames:
            x = _unpack(f["numbers"], size)
            best, _ = nearest(x, centroids)
            small = np.abs(x.astype(np.float64)).max(initial=0) < (1 << 40)  # a batch has far fewer than 2^22 rows
            for i in np.unique(best):
                own = x[best == i]
                sums[i] += (own if small else own.astype(object)).sum(axis=0).astype(object)
                counts[i] += len(own)
        own = np.flatnonzero(counts)
        yield pd.DataFrame({"cluster": np.repeat(own, size), "place": np.tile(np.arange(size), len(own)), "total": [Decimal(int(x)) for i in own for x in sums[i]], "n": np.repeat(counts[own], size)})

    parts = numbers.select("numbers").mapInPandas(run, "cluster int, place int, total decimal(38,0), n bigint")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
    return out


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    numbers = components(vectors, id_col, vector_col, size, scale)
    centroids = start(numbers, k, size, seed)
    for _ in range(rounds if centroids else 0):
        if (moved := step(numbers, centroids)) == centroids:
            break  # further rounds would change nothing
        centroids = moved

    def run(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                best, far = nearest(_unpack(f["numbers"], size), centroids)
                yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64").mask(f["no_id"]), "cluster": best.astype(np.int32), "distance": pd.array([int(d) if d <= LONG else None for d in far], "Int64")})

    placed = written(numbers.mapInPandas(run, "vec_id bigint, cluster int, distance bigint"), "cluster-placed")
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["total"] for r in placed.groupBy("cluster").agg(whole.alias("total")).collect()}
    fit = lambda total: None if total is None or total > LONG else int(total)
    inertia = None if None in sums.values() else fit(sum(sums.values()))
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = placed.sparkSession.createDataFrame([(i, fit(sums[i]), inertia, prints[i]) for i in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
