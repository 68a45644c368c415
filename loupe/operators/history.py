"""Comparing runs: ordered matching, hash differences, freshness, verdicts and seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How often an outcome that disagrees is tried again, and the outcomes that count as noticed (fixed values).
RERUNS, NOTICED = 2, ("killed", "timeout", "over-limit")


def occurrences(rows: DataFrame, keys: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Rows numbered from 0 among those of equal keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def occurrence_join(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The n-th row of a key on one side with the n-th of the other; left rows without one stay."""
    return occurrences(left, keys, order).join(occurrences(right, keys, order).withColumnsRenamed({c: f"{c}_recorded" for c in right.columns if c not in keys}), [*keys, "occurrence"], "left")


def pair_by_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new entries (id, ord, hash) of equal id, each used once: first by equal hash in order, then what is left in order."""
    o = occurrences(old, ["id", "hash"], ["ord"]).withColumnRenamed("ord", "old_ord")
    n = occurrences(new, ["id", "hash"], ["ord"]).withColumnRenamed("ord", "new_ord")
    same = o.join(n, ["id", "hash", "occurrence"]).select("id", "old_ord", "new_ord", F.lit(True).alias("same_hash"))
    rest_old = occurrences(o.join(same, ["id", "old_ord"], "left_anti").select("id", "old_ord"), ["id"], ["old_ord"])
    rest_new = occurrences(n.join(same, ["id", "new_ord"], "left_anti").select("id", "new_ord"), ["id"], ["new_ord"])
    return same.unionByName(rest_old.join(rest_new, ["id", "occurrence"]).select("id", "old_ord", "new_ord", F.lit(False).alias("same_hash")))


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, state): added, removed, changed or same, from (key, hash) of both sides."""
    both = old.select("key", F.col("hash").alias("was"), F.lit(True).alias("had")).join(new.select("key", F.col("hash").alias("now"), F.lit(True).alias("has")), "key", "full_outer")
    return both.select("key", F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "same").otherwise("changed").alias("state"))


def orphans(recorded: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Recorded rows whose key is no longer there."""
    return recorded.join(present.select(*keys).distinct(), keys, "left_anti")


def freshness(missing: Column, hash_changed: Column, tests_changed: Column, marked: Column, listed_changed: Column, broad_changed: Column, unrecorded: Column) -> Column:
    """Why a recorded result holds no longer; the first reason in this order, else fresh."""
    reasons = {"missing": missing, "stale: code": hash_changed, "stale: tests": tests_changed, "stale: marked": marked, "stale: listed": listed_changed, "stale: suite": broad_changed, "stale: unrecorded": unrecorded}
    out = F
    for reason, holds in reasons.items():
        out = out.when(holds, reason)
    return out.otherwise("fresh")


def judged(over_limit: Column, timed_out: Column, failed: Column) -> Column:
    """The outcome of a trial; limits come before failures."""
    return F.when(over_limit, "over-limit").when(timed_out, "timeout").when(failed, "killed").otherwise("survived")


def agrees(recorded: Column, outcome: Column) -> Column:
    return (recorded == outcome) | (recorded.isin(*NOTICED) & outcome.isin(*NOTICED))


def trial_verdicts(trials: DataFrame, reruns: int = RERUNS) -> DataFrame:
    """(id, recorded, trials, verdict) from trials (id, recorded, ord, outcome): agreed at once, flaky if a later one of the first reruns + 1 agrees, mismatched if none does, else pending.

    The first trial that agrees decides, so each id needs two aggregates and no ordered window.
    """
    first = F.min(F.when(agrees(F.col("recorded"), F.col("outcome")), F.col("ord"))).alias("agreed_at")
    sums = trials.groupBy("id", "recorded").agg(F.count("*").alias("trials"), F.min("ord").alias("first_at"), first)
    verdict = F.when(F.col("agreed_at") == F.col("first_at"), "agreed").when(F.col("agreed_at").isNotNull(), "flaky").when(F.col("trials") <= reruns, "pending").otherwise("mismatched")
    return sums.select("id", "recorded", "trials", verdict.alias("verdict"))


def settled(trials: DataFrame, reruns: int = RERUNS) -> DataFrame:
    """(id, state) of trials (id, outcome): flaky if they disagree, agreed after more than reruns, else pending."""
    noticed = F.when(F.col("outcome").isin(*NOTICED), "noticed").otherwise(F.col("outcome"))
    sums = trials.groupBy("id").agg(F.min(noticed).alias("lo"), F.max(noticed).alias("hi"), F.count("*").alias("n"))
    return sums.select("id", F.when(F.col("lo") != F.col("hi"), "flaky").when(F.col("n") <= reruns, "pending").otherwise("agreed").alias("state"))


def rank(seed: str, *parts: Column) -> Column:
    """The place of a row in a seeded draw: SHA-256 of the seed and its parts, joined by NUL."""
    return F.sha2(F.concat_ws("\0", F.lit(seed), *parts), 256)


def draw(rows: DataFrame, seed: str, columns: list[str], count: int) -> DataFrame:
    """`count` rows without replacement; the same for the same seed whatever the partitioning."""
    return rows.withColumn("rank", rank(seed, *(F.col(c).cast("string") for c in columns))).orderBy("rank", *columns).limit(count)


def compare_runs(previous: DataFrame, current: DataFrame) -> DataFrame:
    """current (file, pressure) with its change since the previous run and a verdict; NULL for new files."""
    from loupe.functions.scores import rounded, verdict

    joined = current.join(previous.select("file", F.col("pressure").alias("previous_pressure")), "file", "left")
    return joined.withColumn("delta", rounded(F.col("pressure") - F.col("previous_pressure"))).withColumn("verdict", F.when(F.col("delta").isNotNull(), verdict(F.col("delta"))))


def tallies(mutants: DataFrame) -> DataFrame:
    """killed, survived and uncovered of each unit; kills are noticed outcomes."""
    return mutants.groupBy("unit").agg(F.count_if(F.col("outcome").isin(*NOTICED)).alias("killed"), F.count_if(F.col("outcome") == "survived").alias("survived"), F.count_if(F.col("outcome") == "uncovered").alias("uncovered"), F.count_if(F.col("outcome") != "skipped").alias("sites"))


#: Fixed value: the version that fresh ranks begin with.
FRESH_PLAN = "fresh-plan-v2"


def fresh_plan(sites: DataFrame, seed: str, count: int) -> DataFrame:
    """sites (path, identity) with `rank`, a hash of the seed and the site, and whether it is among the `count` first by rank and identity; each site is one row."""
    ranked = sites.withColumn("rank", rank(FRESH_PLAN, F.lit(seed), F.translate("path", "\\", "/"), F.col("identity")))
    first = ranked.orderBy("rank", "identity").limit(count).select("rank", "identity", F.lit(True).alias("selected"))
    return ranked.join(first, ["rank", "identity"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
