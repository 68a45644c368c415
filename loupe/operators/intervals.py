"""Which of a file's nested spans holds a place: sweeps in order, so work is linear in places and spans but for their sort.

Spans of a file are nested or apart, as subtrees are (pre-order numbers pre to post) and the lines of functions.  Each span
opens and closes; the running count of open ones is a place's depth, and the span that holds it most closely is the last one
that opened at that depth.  Both are window functions over a file's places, so nothing grows with places x spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _swept(points: DataFrame, spans: DataFrame, key: str, at: str, low: str, high: str, own: bool) -> DataFrame:
    """Opens, closes and points of a key with `depth`, the number of spans that are open there; a point is in `point`, an opening span in `span`."""
    spans = spans.where(F.col(low) <= F.col(high))
    none = lambda df: F.lit(None).cast(df.schema.simpleString())
    held = F.struct(*(F.col(f"`{c}`") for c in spans.columns))
    opens = spans.select(F.col(key).alias("key"), F.col(low).alias("place"), F.lit(0 if own else 2).alias("turn"), F.col(high).alias("until"), F.lit(1).alias("step"), none(points).alias("point"), held.alias("span"))
    closes = spans.select(F.col(key).alias("key"), F.col(high).alias("place"), F.lit(3).alias("turn"), F.lit(None).alias("until"), F.lit(-1).alias("step"), none(points).alias("point"), none(spans).alias("span"))
    places = points.select(F.col(key).alias("key"), F.col(at).alias("place"), F.lit(1).alias("turn"), F.lit(None).alias("until"), F.lit(0).alias("step"), F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("point"), none(spans).alias("span"))
    rows = opens.unionByName(closes).unionByName(places)
    return rows.withColumn("depth", F.sum("step").over(Window.partitionBy("key").orderBy("place", "turn", F.col("until").desc()).rowsBetween(Window.unboundedPreceding, 0)))


def innermost(points: DataFrame, spans: DataFrame, key: str = "file", at: str = "pre", low: str = "low", high: str = "high", own: bool = True, outer: bool = False) -> DataFrame:
    """points with the columns of the innermost span (key, low, high, ...) that holds them; those in none only with `outer`, with nulls.

    own: whether a span holds its first place.  The two share no column but the key.  A null key or place is in no span.
    """
    rows = _swept(points, spans.where(F.col(key).isNotNull()), key, at, low, high, own)
    last = F.last("span", ignorenulls=True).over(Window.partitionBy("key", "depth").orderBy("place", "turn", F.col("until").desc()).rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("in", F.when((F.col("depth") > 0) & F.col("place").isNotNull(), last)).where("point IS NOT NULL")
    found = found if outer else found.where("in IS NOT NULL")
    return found.select("point.*", *(F.col("in")[c].alias(c) for c in spans.columns if c != key))


def outside(points: DataFrame, spans: DataFrame, key: str = "file", at: str = "pre", low: str = "low", high: str = "high", own: bool = True) -> DataFrame:
    """The points that no span (key, low, high) holds."""
    return _swept(points, spans.select(key, low, high).where(F.col(key).isNotNull()), key, at, low, high, own).where("point IS NOT NULL AND (depth = 0 OR place IS NULL)").select("point.*")
