"""Readers of coverage reports, diffs and test listings, as DataFrame operations over whole text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENTS = "file string, is_branch boolean, ord int, start int, end int, total double, covered double, key string, ran boolean, from_mask int"


def lines_of(reports: DataFrame) -> DataFrame:
    """(report, pos, line) of reports (report, text)."""
    return reports.select("report", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw")).select("report", "pos", F.trim("raw").alias("line"))


def sniff(text) -> object:
    """go, xml or lcov from the first characters."""
    head = F.ltrim(F.substring(text, 1, 256))
    return F.when(head.startswith("mode:"), "go").when(head.startswith("<"), "xml").otherwise("lcov")


def read_lcov(reports: DataFrame, from_mask: int = 1) -> DataFrame:
    """Line segments of DA records and branch segments of BRDA blocks with two arms or more."""
    order = Window.partitionBy("report").orderBy("pos")
    rows = lines_of(reports).withColumn("mark", F.when(F.col("line").startswith("SF:"), F.substring("line", 4, 1 << 20)).when(F.col("line") == "end_of_record", ""))
    rows = rows.withColumn("file", F.last("mark", ignorenulls=True).over(order)).withColumn("record", F.count("mark").over(order)).where("file <> ''")
    da = F.regexp_extract("line", r"^DA:(\d+),([^,]+)", 1), F.regexp_extract("line", r"^DA:(\d+),([^,]+)", 2).try_cast("double")
    hits = rows.where("line LIKE 'DA:%'").select("file", "pos", da[0].alias("key"), da[1].alias("hits")).where("key <> '' AND hits IS NOT NULL")
    plain = hits.select("file", F.lit(False).alias("is_branch"), F.col("pos").cast("int").alias("ord"), F.col("key").cast("int").alias("start"), F.col("key").cast("int").alias("end"), F.lit(1.0).alias("total"), (F.col("hits") > 0).cast("double").alias("covered"), "key", (F.col("hits") > 0).alias("ran"))
    arm = r"^BRDA:(\d+),([^,]*),.*?([^,]*)$"
    arms = rows.where("line LIKE 'BRDA:%'").select("file", "report", "record", "pos", *(F.regexp_extract("line", arm, i).alias(n) for i, n in ((1, "at"), (2, "block"), (3, "taken")))).where("at <> ''")
    took = F.coalesce(F.col("taken").try_cast("double"), F.lit(0.0)) > 0
    blocks = arms.groupBy("file", "report", "record", "at", "block").agg(F.min("pos").cast("int").alias("ord"), F.count("*").cast("double").alias("total"), F.count_if(took).cast("double").alias("covered")).where("total >= 2")
    branch = blocks.select("file", F.lit(True).alias("is_branch"), "ord", F.col("at").cast("int").alias("start"), F.col("at").cast("int").alias("end"), "total", "covered", F.concat_ws(",", "at", "block").alias("key"), (F.col("covered") > 0).alias("ran"))
    return plain.unionByName(branch).withColumn("from_mask", F.lit(from_mask))


def read_go_cover(reports: DataFrame, from_mask: int = 1) -> DataFrame:
    """A segment for each block of a Go cover profile; blocks without statements weigh nothing but may have run."""
    block = r"^(.*):(\d+)\.(\d+),(\d+)\.(\d+)\s+(\S+)\s+(\S+)$"
    part = lambda i: F.regexp_extract("line", block, i)
    rows = lines_of(reports).where("line <> '' AND line NOT LIKE 'mode:%'").where(F.col("line").rlike(block))
    ran = part(7).try_cast("double") > 0
    weight = part(6).try_cast("double")
    return rows.select(part(1).alias("file"), F.lit(False).alias("is_branch"), F.col("pos").cast("int").alias("ord"), part(2).cast("int").alias("start"), part(4).cast("int").alias("end"), weight.alias("total"), F.when(ran, weight).otherwise(0.0).alias("covered"), F.regexp_extract("line", r":(\d+\.\d+,\d+\.\d+)\s", 1).alias("key"), ran.alias("ran"), F.lit(from_mask).alias("from_mask"))


JACOCO = "_name string, sourcefile array<struct<_name:string, line:array<struct<_nr:int,_mi:double,_ci:double,_mb:double,_cb:double>>>>"


def read_jacoco(spark: SparkSession, path: str, from_mask: int = 1) -> DataFrame:
    """Line segments weighing instructions and branch segments weighing branches, from JaCoCo or Kover XML."""
    return jacoco_segments(spark.read.format("xml").option("rowTag", "package").schema(JACOCO).load(path), from_mask)


def jacoco_segments(packages: DataFrame, from_mask: int = 1) -> DataFrame:
    files = packages.select(F.col("_name").alias("package"), F.explode("sourcefile").alias("f"))
    rows = files.select(F.when(F.coalesce("package", F.lit("")) == "", F.col("f._name")).otherwise(F.concat_ws("/", "package", "f._name")).alias("file"), F.posexplode("f.line").alias("ord", "l"))
    zero = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit(0.0))

    def part(branch: bool, missed: str, covered: str) -> DataFrame:
        return rows.select("file", F.lit(branch).alias("is_branch"), "ord", F.col("l._nr").alias("start"), F.col("l._nr").alias("end"), (zero(missed) + zero(covered)).alias("total"), zero(covered).alias("covered"), F.col("l._nr").cast("string").alias("key"), (zero(covered) > 0).alias("ran"))

    return part(False, "_mi", "_ci").unionByName(part(True, "_mb", "_cb").where("total > 0")).withColumn("from_mask", F.lit(from_mask))


def _file_name(column):
    """A name of a diff header: quotes undone, the b/ prefix required by the caller."""
    bare = F.regexp_replace(column, r"\t$", "")
    return F.when(bare.startswith('"'), F.regexp_replace(F.regexp_replace(bare, r'^"|"$', ""), r'\\(["\\])', "$1")).otherwise(bare)


def read_diff(diffs: DataFrame) -> DataFrame:
    """(file, start, end, deletion) of the hunks of unified diffs (report, text) with no context; a pure deletion marks the lines around it."""
    order = Window.partitionBy("report").orderBy("pos")
    rows = diffs.select("report", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("begin", F.when(F.col("line").startswith("diff --git "), F.col("pos"))).withColumn("begin", F.last("begin", ignorenulls=True).over(order))
    part = Window.partitionBy("report", "begin").orderBy("pos")
    rows = rows.withColumn("hunks", F.count(F.when(F.col("line").startswith("@@ "), 1)).over(part))
    name = _file_name(F.substring("line", 5, 1 << 20))
    mark = F.when((F.col("hunks") == 0) & F.col("line").startswith("+++ "), F.when(name.startswith("b/"), F.substring(name, 3, 1 << 20)).otherwise(""))
    rows = rows.withColumn("file", F.last(mark, ignorenulls=True).over(part))
    hunk = r"^@@ \S+ \+(\d+)(?:,(\d+))?"
    found = rows.where("line LIKE '@@ %' AND file <> ''").select("file", F.regexp_extract("line", hunk, 1).alias("at"), F.regexp_extract("line", hunk, 2).alias("n")).where("at <> ''")
    start, count = F.col("at").cast("int"), F.when(F.col("n") == "", 1).otherwise(F.col("n").try_cast("int"))
    return found.select("file", start.alias("start"), F.when(count == 0, start + 1).otherwise(start + count - 1).alias("end"), (count == 0).alias("deletion"))


def read_renames(diffs: DataFrame) -> DataFrame:
    """(to, from) of renames in unified diffs."""
    order = Window.partitionBy("report").orderBy("pos")
    rows = diffs.select("report", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    from_ = F.when(F.col("line").startswith("rename from "), _file_name(F.substring("line", 13, 1 << 20))).when(F.col("line").startswith("diff --git "), "")
    rows = rows.withColumn("from", F.last(from_, ignorenulls=True).over(order))
    return rows.where("line LIKE 'rename to %' AND from <> ''").select(_file_name(F.substring("line", 11, 1 << 20)).alias("to"), "from")


def read_listing(listings: DataFrame) -> DataFrame:
    """(ord, id, file, fingerprint) of listed tests, tab-separated; missing parts are empty."""
    parts = F.split("line", "\t")
    rows = listings.select("report", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line")).where("trim(line) <> ''")
    return rows.select("ord", *(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("id", "file", "fingerprint"))))
