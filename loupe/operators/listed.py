"""Outcomes that rest on listed tests: which rest on all importing tests instead, and which of those they rest on have changed.

Shared columns: listed (snapshot, test, file, fingerprint), the tests that a snapshot recorded, listed_files (snapshot, file, hash), mutants
(snapshot, unit, key, scope, outcome, tests).  An empty file, hash or fingerprint counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.operators.history import NOTICED

#: The scope of outcomes that listed tests decided (fixed value).
LISTED = "listed"


def _some(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def dated(listed: DataFrame, listed_files: DataFrame) -> DataFrame:
    """(snapshot, test) of tests that a snapshot dates by itself: with a fingerprint, or by a hash of the file that defines them."""
    hashed = listed_files.where(_some("hash")).select("snapshot", "file").distinct().withColumn("hashed", F.lit(True))
    rows = listed.join(hashed, ["snapshot", "file"], "left")
    return rows.where(_some("fingerprint") | (_some("file") & F.col("hashed"))).select("snapshot", "test").distinct()


def rests_on_importers(mutants: DataFrame, listed: DataFrame, listed_files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """mutants with rests_on_importers: all but what listed tests noticed, each of them dated, in a snapshot (snapshots: snapshot, records_tests) that records its tests."""
    named = mutants.where((F.col("scope") == LISTED) & F.col("outcome").isin(*NOTICED)).select("snapshot", "unit", "key", F.explode("tests").alias("test")).distinct()
    known = dated(listed, listed_files).withColumn("is_dated", F.lit(True))
    all_ = named.join(known, ["snapshot", "test"], "left").groupBy("snapshot", "unit", "key").agg(F.bool_and(F.coalesce("is_dated", F.lit(False))).alias("all_dated"))
    rows = mutants.join(all_, ["snapshot", "unit", "key"], "left").join(snapshots.select("snapshot", "records_tests"), "snapshot", "left")
    apart = (F.col("scope") == LISTED) & F.col("outcome").isin(*NOTICED) & F.coalesce("all_dated", F.lit(False)) & F.coalesce("records_tests", F.lit(False))
    return rows.select(*mutants.columns, (~F.coalesce(apart, F.lit(False))).alias("rests_on_importers"))


def units_resting(units: DataFrame, mutants: DataFrame) -> DataFrame:
    """units (snapshot, unit) with rests_on_importers: any of their mutants (rests_on_importers) does, and so does a unit that recorded none."""
    of = mutants.groupBy("snapshot", "unit").agg(F.bool_or("rests_on_importers").alias("rests_on_importers"))
    return units.join(of, ["snapshot", "unit"], "left").withColumn("rests_on_importers", F.coalesce("rests_on_importers", F.lit(True)))


def usable(mutants: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """The mutants (snapshot, rests_on_importers) that still hold: all of a snapshot whose tests (snapshot, file, hash) are as it recorded them, else those apart from importers."""
    a, b = before.select("snapshot", "file", F.col("hash").alias("x")), now.select("snapshot", "file", F.col("hash").alias("y"))
    differ = a.join(b, ["snapshot", "file"], "full_outer").where(~F.col("x").eqNullSafe(F.col("y"))).select("snapshot").distinct().withColumn("differ", F.lit(True))
    return mutants.join(differ, "snapshot", "left").where("differ IS NULL OR NOT rests_on_importers").select(*mutants.columns)


def changed_tests(listed: DataFrame, listed_files: DataFrame, now: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(snapshot, test, change) of listed tests that are no longer as recorded.

    now: file, hash.  listing: test, fingerprint, what the list command prints now; None if it wasn't run.  A test without a fingerprint
    changed with its file: change is the file.  One with a fingerprint whose file is as it was holds; else it changed (change NULL)
    unless the list still prints it with its fingerprint, whatever file that names.
    """
    then = listed_files.select("snapshot", "file", F.col("hash").alias("then"))
    rows = listed.join(then, ["snapshot", "file"], "left").join(now.select("file", F.col("hash").alias("now")).distinct(), "file", "left")
    moved = F.coalesce("now", F.lit("")) != F.coalesce("then", F.lit(""))
    if listing is None:
        rows = rows.withColumn("printed", F.lit(None).cast("string"))
    else:
        rows = rows.join(listing.groupBy("test").agg(F.min("fingerprint").alias("printed")), "test", "left")
    bare = ~_some("fingerprint") & _some("file") & moved
    printed = _some("fingerprint") & (~_some("file") | moved) & ~F.col("printed").eqNullSafe(F.col("fingerprint"))
    return rows.where(bare | printed).select("snapshot", "test", F.when(bare, F.col("file")).alias("change"))


def listed_change(mutants: DataFrame, changes: DataFrame, support: DataFrame) -> DataFrame:
    """(snapshot, unit, files, tests, changed) of units with listed outcomes: what those rest on that changed.

    changes: changed_tests; support: snapshot, file, the support files that were changed, added or removed.  files are those of tests without a fingerprint, and
    the support files; tests those with one.  Both are sorted, each entry once.
    """
    own = mutants.where(F.col("scope") == LISTED).select("snapshot", "unit", "tests")
    units = own.select("snapshot", "unit").distinct()
    hits = own.select("snapshot", "unit", F.explode("tests").alias("test")).distinct().join(changes, ["snapshot", "test"])
    all_ = hits.select("snapshot", "unit", F.col("change").alias("file"), F.when(F.col("change").isNull(), F.col("test")).alias("test"))
    all_ = all_.unionByName(units.join(support.select("snapshot", "file").distinct(), "snapshot").select("snapshot", "unit", "file", F.lit(None).cast("string").alias("test")))
    sums = all_.groupBy("snapshot", "unit").agg(F.array_sort(F.collect_set("file")).alias("files"), F.array_sort(F.collect_set("test")).alias("tests"))
    none = F.array().cast("array<string>")
    rows = units.join(sums, ["snapshot", "unit"], "left").select("snapshot", "unit", F.coalesce("files", none).alias("files"), F.coalesce("tests", none).alias("tests"))
    return rows.withColumn("changed", (F.size("files") > 0) | (F.size("tests") > 0))
