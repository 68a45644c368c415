"""CRAP: complexity against coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.functions import scores


def score(units: DataFrame, digits: int = 2) -> DataFrame:
    """units with complexity and coverage (NULL: unmeasured) get crap and band."""
    value = scores.rounded(scores.crap(F.col("complexity"), F.col("coverage")), digits)
    return units.withColumn("crap", value).withColumn("band", scores.band(F.col("crap")))


def worst(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Scored before unscored, CRAP then complexity falling, then by ord; the first `top` if given."""
    ordered = scored.orderBy(F.col("crap").isNull(), F.col("crap").desc(), F.col("complexity").desc(), "ord")
    return ordered if top is None else ordered.limit(top)


def problems(scored: DataFrame, threshold: float) -> DataFrame:
    """Units strictly above the threshold, as findings."""
    return scored.where(F.col("crap") > threshold).withColumn("rule", F.lit("crap"))


def gate(scored: DataFrame, threshold: float, gaps: DataFrame) -> DataFrame:
    """Findings (rule, place, detail, crap) of a threshold: first each root that wasn't measured, as nothing can be said of it, then the units above the threshold, worst first.

    scored: file, start_line, namespace, name, complexity, crap, ord.  gaps: dir, language, why; equal ones are one.
    """
    missing = gaps.select("dir", "language", "why").distinct().select(F.lit("coverage").alias("rule"), F.struct(F.lit(0).alias("turn"), F.lit(0.0).alias("a"), F.lit(0).alias("b"), F.col("dir").alias("c"), F.col("language").alias("d"), F.lit(0).cast("bigint").alias("e")).alias("order"), F.col("dir").alias("place"), F.concat_ws(": ", "language", "why").alias("detail"), F.lit(None).cast("double").alias("crap"))
    above = problems(scored, threshold).select(F.lit("crap").alias("rule"), F.struct(F.lit(1).alias("turn"), (-F.col("crap")).alias("a"), (-F.col("complexity")).cast("int").alias("b"), F.lit("").alias("c"), F.lit("").alias("d"), F.col("ord").cast("bigint").alias("e")).alias("order"), F.concat_ws(":", "file", "start_line").alias("place"), F.concat_ws("#", "namespace", "name").alias("detail"), "crap")
    return missing.unionByName(above).orderBy("order", "place").drop("order")


def measured_languages(units: DataFrame) -> DataFrame:
    """Languages with any measured unit; in them an unreported file has share 0, elsewhere it is unmeasured."""
    return units.where("coverage IS NOT NULL").select("language").distinct()


def unloaded_as_untested(units: DataFrame) -> DataFrame:
    languages = measured_languages(units).withColumn("measured", F.lit(True))
    filled = F.when(F.col("coverage").isNull() & F.col("measured"), 0.0).otherwise(F.col("coverage"))
    return units.join(languages, "language", "left").withColumn("coverage", filled).drop("measured")
