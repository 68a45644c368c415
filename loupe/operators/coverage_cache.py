"""Kept coverage of plans, served while nothing that it was measured from has changed.

The cache is a table that is only appended to, (bucket, name, entry, at, kind, item, value), partitioned by a hash of the plan's name.  An entry is
what one run kept of one plan: a row `inputs` for each input (item: its name, value: its hash), a row `sources` for each file measured, a row
`pieces` for each piece (item: the file, value: what was measured of it), and a row `head` with the digest of all inputs and the number
of other rows.  An entry whose rows aren't all there yet is never served, so a run may read while others write, and two that write the same plan
leave two entries of which the later counts.  A look-up reads the buckets of the wanted names only, and compares inputs one by one only
where the digests differ.  What is kept of a plan is never changed: a newer entry takes its place, and `compact` drops the older ones.

Shared columns: inputs (name, item, value), sources (name, item).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.operators.tables import cut
from loupe.sinks import first_three

BUCKETS = 64
CACHE = "name string, entry string, at timestamp, kind string, item string, value string, bucket int"
#: Partial sums of the parts of row hashes; each part has 60 bits, so a decimal holds the sum over any table.
PARTS = 4


def _bucket() -> Column:
    return F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int")


def digests(inputs: DataFrame) -> DataFrame:
    """(name, digest) over the set of a plan's inputs.

    Hashes of the inputs are added up, so tasks combine them before anything is shuffled and no plan's inputs are gathered in
    one place; order doesn't matter.
    """
    row = F.sha2(F.to_json(F.struct("item", "value"), {"ignoreNullFields": "false"}), 256)
    rows = inputs.select("name", "item", "value").distinct().withColumn("h", row)
    sums = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(PARTS)]
    sums = rows.groupBy("name").agg(*sums, F.count("*").cast("string").alias("n"))
    return sums.select("name", F.sha2(F.concat_ws(":", *(f"s{i}" for i in range(PARTS)), "n"), 256).alias("digest"))


def read(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """The rows of the latest whole entry of each name; only the buckets of the names are read.  An absent or empty cache has none."""
    wanted = names.select("name").distinct()
    buckets = [r["b"] for r in wanted.select(_bucket().alias("b")).distinct().collect()]  # BUCKETS at most
    if not exists(spark, path):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).parquet(path).where(F.col("bucket").isin(buckets)).join(wanted, "name", "left_semi")
    heads = rows.where("kind = 'head'").select("name", "entry", "at", F.get_json_object("value", "$.rows").cast("bigint").alias("n"))
    there = rows.where("kind <> 'head'").groupBy("entry").agg(F.count("*").alias("found"))
    whole = heads.join(there, "entry", "left").where(F.coalesce("found", F.lit(0)) == F.col("n"))
    latest = whole.groupBy("name").agg(F.max(F.struct("at", "entry")).alias("last")).select("name", F.col("last.entry").alias("entry"))
    return rows.join(latest, ["name", "entry"], "left_semi")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def serve(cached: DataFrame, inputs: DataFrame, sources: DataFrame, exact: bool = True) -> DataFrame:
    """(name, entry, state, why) of each name in sources or inputs: how the kept entry (rows of `read`) bears on a run.

    served: the inputs are as they were, and it measured the run's sources (no others, if `exact`).  changed, unmeasured, also: what differs, in
    this order; why names three at most.  missing: nothing whole is kept.
    """
    names = inputs.select("name").unionByName(sources.select("name")).distinct()
    heads = cached.where("kind = 'head'").select("name", "entry", F.get_json_object("value", "$.digest").alias("kept"))
    known = cut(names.join(heads, "name", "left").join(digests(inputs), "name", "left"))
    unlike = known.where("entry IS NOT NULL AND NOT kept <=> digest").select("name")
    rows = cached.where("kind = 'inputs'").select("name", "item", F.col("value").alias("then")).join(unlike, "name", "left_semi")
    now = inputs.select("name", "item", F.col("value").alias("now")).distinct().join(unlike, "name", "left_semi")
    differ = now.withColumn("a", F.lit(True)).join(rows.withColumn("b", F.lit(True)), ["name", "item"], "full_outer").where("a IS NULL OR b IS NULL OR NOT now <=> then")
    sorted_ = lambda c: F.array_sort(F.collect_set(c))
    changed = differ.groupBy("name").agg(sorted_(F.regexp_replace("item", "^support:", "")).alias("changed"))
    measured = cached.where("kind = 'sources'").select("name", "item", F.lit(True).alias("kept"))
    both = sources.select("name", "item").distinct().withColumn("asked", F.lit(True)).join(measured, ["name", "item"], "full_outer")
    files = both.groupBy("name").agg(sorted_(F.when(F.col("kept").isNull(), F.col("item"))).alias("unmeasured"), sorted_(F.when(F.col("asked").isNull(), F.col("item"))).alias("also"))
    all_ = known.select("name", "entry").join(changed, "name", "left").join(files, "name", "left")
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    also = some("also") & F.lit(exact)
    state = F.when(F.col("entry").isNull(), "missing").when(some("changed"), "changed").when(some("unmeasured"), "unmeasured").when(also, "also").otherwise("served")
    why = F.when(state == "changed", first_three(F.transform("changed", lambda x: F.concat(x, F.lit(" changed"))))).when(state == "unmeasured", F.concat(F.lit("it measured no "), first_three(F.col("unmeasured")))).when(state == "also", F.concat(F.lit("it also measured "), first_three(F.col("also"))))
    return all_.select("name", "entry", state.alias("state"), why.alias("why"))


def serve_groups(served: DataFrame, plans: DataFrame) -> DataFrame:
    """served with whether a run uses it: every plan (name, group) of its group has to be served."""
    whole = plans.join(served, "name", "left").groupBy("group").agg(F.bool_and(F.coalesce(F.col("state") == "served", F.lit(False))).alias("used"))
    return served.join(plans, "name").join(whole, "group").select(*served.columns, "used")


def pieces(cached: DataFrame, served: DataFrame) -> DataFrame:
    """(name, item, value) of what the served entries measured."""
    return cached.where("kind = 'pieces'").join(served.where("state = 'served'").select("entry"), "entry", "left_semi").select("name", "item", "value")


def keep(spark: SparkSession, path: str, inputs: DataFrame, sources: DataFrame, measured: DataFrame, kept: DataFrame | None = None) -> None:
    """Appends an entry for each name of sources: what a run measured (name, item, value) of them.

    kept: rows of `read` of entries with the same inputs, to which this adds: sources and pieces of theirs that the run didn't measure stay.
    Names of other inputs are to be left out of it.
    """
    names = sources.select("name").distinct()
    rows = inputs.select("name", F.lit("inputs").alias("kind"), "item", "value").distinct().join(names, "name", "left_semi")
    if kept is not None:
        old = kept.where("kind = 'pieces'").join(sources.select("name", "item").distinct(), ["name", "item"], "left_anti").select("name", "item", "value")
        measured = measured.select("name", "item", "value").unionByName(old)
        sources = sources.select("name", "item").unionByName(kept.where("kind = 'sources'").select("name", "item"))
    rows = rows.unionByName(sources.select("name", F.lit("sources").alias("kind"), "item", F.lit(None).cast("string").alias("value")).distinct())
    rows = cut(rows.unionByName(measured.select("name", F.lit("pieces").alias("kind"), "item", "value").join(names, "name", "left_semi")))
    counts = names.join(rows.groupBy("name").agg(F.count("*").alias("rows")), "name", "left").join(digests(inputs), "name", "left")
    head = counts.select("name", F.lit("head").alias("kind"), F.lit(None).cast("string").alias("item"), F.to_json(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "digest")).alias("value"))
    run = uuid.uuid4().hex
    all_ = rows.unionByName(head).select("name", F.concat(F.lit(run + "-"), F.sha2("name", 256)).alias("entry"), F.current_timestamp().alias("at"), "kind", "item", "value", _bucket().alias("bucket"))
    all_.write.mode("append").partitionBy("bucket").parquet(path)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Writes the latest whole entry of every name to a new cache: the one step that reads it all, for upkeep."""
    names = spark.read.schema(CACHE).parquet(path).where("kind = 'head'").select("name").distinct()
    read(spark, path, names).write.mode("append").partitionBy("bucket").parquet(to)
