"""Connected components of links: by union-find in one task while links are few, else by alternating large-star and small-star steps, each a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import written


#: Links that one task takes at most, some 100 bytes each in its memory; a few hundred small jobs cost more than that.
ONE_TASK = 1 << 18


def _union(batches):
    """(node, root) of all links."""
    import pyarrow as pa

    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for i in range(0, len(nodes), 1 << 16):
        part = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "root"])


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node of its component.

    links: two bigint columns.  Nothing is gathered: a node's smallest neighbour is an aggregate, and
    the join that hands it to the node's links may be split by adaptive execution where a node has many.
    No links: an empty result.  Links of a node with itself and nulls are ignored.
    """
    a, b = links.columns
    pairs = written(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "stars")
    state = _state(pairs)
    if state[0] <= ONE_TASK:
        return pairs.repartition(1).mapInArrow(_union, "node bigint, root bigint")
    while state[0]:
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        pairs = written(small, "stars")
        if (now := _state(pairs)) == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
