"""Recorded mutation results: what can be reused, what a run has to do, and what its numbers say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.operators.history import NOTICED, RERUNS, pair_by_hash

#: Scopes whose outcomes rest on a whole suite (fixed values).
BROAD = ("all", "shell", "suite")


def on_sites(entries: DataFrame, mutants: DataFrame, functions: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recorded entries and mutants as far as the code still has them: mutants without a site now leave, and the counts lose theirs.

    entries: unit, hash, sites, killed, survived, uncovered.  mutants: unit, key, outcome, flaky, line, column.  functions: unit, hash, as they are
    now.  sites: unit, key, line, column.  Only entries of the function's hash now are changed, others are stale anyway; their mutants get the
    place of their site now.  Flaky mutants count as a site and as nothing else.  Of equal keys in a unit the last place counts.
    """
    held = entries.select("unit", "hash").join(functions.select("unit", "hash").distinct(), ["unit", "hash"]).select("unit", F.lit(True).alias("held"))
    places = sites.groupBy("unit", "key").agg(F.max(F.struct("line", "column")).alias("at"))
    rows = mutants.join(held, "unit", "left").join(places, ["unit", "key"], "left")
    gone = F.coalesce("held", F.lit(False)) & F.col("at").isNull()
    judged = F.when(~F.coalesce("flaky", F.lit(False)), F.when(F.col("outcome").isin(*NOTICED), "killed").when(F.col("outcome").isin("survived", "uncovered"), F.col("outcome")))
    lost = rows.where(gone).groupBy("unit").agg(F.count("*").alias("lost_sites"), *(F.count_if(judged == c).alias(f"lost_{c}") for c in ("killed", "survived", "uncovered")))
    counts = {c: F.col(c) - F.coalesce(f"lost_{c}", F.lit(0)) for c in ("sites", "killed", "survived", "uncovered")}
    moved = {c: F.when(F.col("held"), F.col(f"at.{c}")).otherwise(F.col(c)) for c in ("line", "column")}
    return entries.join(lost, "unit", "left").withColumns(counts).select(*entries.columns), rows.where(~gone).withColumns(moved).select(*mutants.columns)


def apply_site(source: Column, start: Column, original: Column, replacement: Column) -> Column:
    """Source bytes with the site's text replaced; start counts bytes from 0."""
    return F.overlay(source, replacement.cast("binary"), start + 1, F.octet_length(original))


def remembered(units: DataFrame, recorded: DataFrame, mutants: DataFrame) -> DataFrame:
    """(unit, key, outcome, scope, tests, flaky) of mutants whose unit is as it was recorded.

    units (unit, id, ord, hash), recorded (entry, id, ord, hash, stale), mutants (entry, key, ...).
    """
    pairs = pair_by_hash(recorded.select("id", "ord", "hash"), units.select("id", "ord", "hash")).where("same_hash")
    same = pairs.join(recorded.select("id", F.col("ord").alias("old_ord"), "entry", "stale"), ["id", "old_ord"]).where("NOT stale").join(units.select("id", F.col("ord").alias("new_ord"), "unit"), ["id", "new_ord"])
    return mutants.join(same.select("entry", "unit"), "entry").select("unit", *[c for c in mutants.columns if c != "entry"])


def run_plan(sites: DataFrame, remembered_: DataFrame, all_sites: bool = False) -> DataFrame:
    """sites (unit, key, judged, excepted) with what a run does: skipped, reused or pending.

    Kills are reused, survivors only if excepted; nothing flaky, nothing whose tests or suite changed.
    remembered_: unit, key, outcome, flaky, rests_on_change, broad_stale.
    """
    rows = sites.join(remembered_, ["unit", "key"], "left")
    holds = F.col("outcome").isin(*NOTICED) | (F.col("excepted") & (F.col("outcome") == "survived"))
    sound = ~F.coalesce("flaky", F.lit(False)) & ~F.coalesce("rests_on_change", F.lit(False)) & ~F.coalesce("broad_stale", F.lit(False)) & F.lit(not all_sites)
    return rows.withColumn("state", F.when(~F.col("judged"), "skipped").when(holds & sound, "reused").otherwise("pending"))


def keep_unjudged(now: DataFrame, was: DataFrame, tests_hold: bool) -> DataFrame:
    """The entries to record: judged units as they are; of others what was recorded, with its old hash so that a later run sees the change, stale if it rests on tests that changed.

    now: id, ord, hash, judged; was: id, ord, hash, stale, rests_on_importers.
    """
    pairs = pair_by_hash(was.select("id", "ord", "hash"), now.select("id", "ord", "hash"))
    both = now.join(pairs.select("id", F.col("new_ord").alias("ord"), "old_ord"), ["id", "ord"], "left").join(was.select("id", F.col("ord").alias("old_ord"), F.col("hash").alias("was_hash"), F.col("stale").alias("was_stale"), "rests_on_importers"), ["id", "old_ord"], "left")
    stale = F.col("was_stale") | (F.lit(not tests_hold) & F.col("rests_on_importers"))
    known = both.where("judged OR was_hash IS NOT NULL")
    return known.select("id", "ord", F.when(F.col("judged"), F.col("hash")).otherwise(F.col("was_hash")).alias("hash"), F.when(F.col("judged"), False).otherwise(stale).alias("stale"), F.when(F.col("judged"), "judged").otherwise("kept").alias("origin"))


def broad_changes(mutants: DataFrame, changed: DataFrame) -> DataFrame:
    """(unit, reasons): changed files (file) that whole-suite outcomes of a unit rest on; without evidence, that itself.

    mutants: unit, scope, evidence (files, NULL if none was kept).
    """
    broad = mutants.where(F.col("scope").isin(*BROAD))
    bare = broad.where("evidence IS NULL").select("unit", F.lit("whole-suite evidence").alias("reason"))
    files = broad.where("evidence IS NOT NULL").select("unit", F.explode("evidence").alias("reason")).join(changed.select(F.col("file").alias("reason")).distinct(), "reason", "left_semi")
    return bare.unionByName(files).groupBy("unit").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file) of file hashes (file, hash) that were added, removed or changed."""
    both = before.select("file", F.col("hash").alias("x")).join(after.select("file", F.col("hash").alias("y")), "file", "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("file")


def uncovered(sites: DataFrame, lines: DataFrame) -> DataFrame:
    """sites (file, line, outcome) marked uncovered where they are still open and their measured line was not run."""
    return sites.join(lines.select("file", "line", "executed"), ["file", "line"], "left").withColumn("outcome", F.when(F.col("outcome").isNull() & ~F.col("executed"), "uncovered").otherwise(F.col("outcome"))).drop("executed")


def coverage_evidence(functions: DataFrame, evidence: DataFrame, changed: DataFrame) -> DataFrame:
    """functions (file, function, hash, supported) with the state of their coverage: unsupported, missing, stale or fresh.

    evidence: file, function, hash, complete, inputs (files); changed: file.  The producer's own entry is no input.
    """
    files = evidence.where("complete").select("file", "function", "hash", F.explode_outer(F.filter("inputs", lambda x: x != "@producer")).alias("input"))
    marked = files.join(changed.select(F.col("file").alias("input"), F.lit(True).alias("hit")).distinct(), "input", "left").groupBy("file", "function", "hash").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    rows = functions.join(marked, ["file", "function", "hash"], "left")
    return rows.withColumn("state", F.when(~F.col("supported"), "unsupported").when(F.col("hit").isNull(), "missing").when(F.col("hit"), "stale").otherwise("fresh")).drop("hit")


def needs_coverage(functions: DataFrame) -> DataFrame:
    """One row: whether any function (state, flaky, open_survivors) has to be measured again."""
    return functions.agg(F.coalesce(F.bool_or((F.col("state") != "fresh") | F.col("flaky") | (F.col("open_survivors") > 0)), F.lit(False)).alias("needed"))


def judge_exceptions(held: DataFrame) -> DataFrame:
    """held (id, outcome) with how an exception now bears: excepted for survivors, stale for what tests notice, none otherwise."""
    return held.withColumn("bearing", F.when(F.col("outcome") == "survived", "excepted").when(F.col("outcome").isin(*NOTICED), "stale").otherwise("none"))


def prune(exceptions: DataFrame) -> DataFrame:
    """Exceptions to keep: those gone, killed or of excluded files leave, others stay however stale."""
    return exceptions.where(~F.coalesce(F.col("why"), F.lit("")).isin("gone", "killed", "excluded"))


def carry_over(exceptions: DataFrame, units: DataFrame) -> DataFrame:
    """Exceptions (id, hash) of an older hash (units: prev_hash, hash) under the new one; where an old hash became several, as they are, since it doesn't say which."""
    new = units.where("prev_hash IS NOT NULL").groupBy(F.col("prev_hash").alias("hash")).agg(F.min("hash").alias("new_hash"), F.count_distinct("hash").alias("n")).where("n = 1").drop("n")
    return exceptions.join(new, "hash", "left").withColumn("hash", F.coalesce("new_hash", "hash")).drop("new_hash").select(*exceptions.columns)


def moved_elsewhere(exceptions: DataFrame, units: DataFrame) -> DataFrame:
    """exceptions (id, file, name, hash) with the one other file that has their function; NULL if none or several."""
    there = units.select("name", "hash", F.col("file").alias("other")).distinct()
    found = exceptions.join(there, ["name", "hash"]).where("other <> file").groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("moved_to")).where("n = 1")
    return exceptions.join(found.select("id", "moved_to"), "id", "left")


def parse_identity(identity: Column) -> dict[str, Column]:
    """The parts of `file:line:column function original -> replacement`."""
    pattern = r"^(.*):(\d+):(\d+) (\S+) (.*) -> (.*)$"
    names = ("file", "line", "column", "function", "original", "replacement")
    return {n: F.regexp_extract(identity, pattern, i + 1).cast("int") if n in ("line", "column") else F.regexp_extract(identity, pattern, i + 1) for i, n in enumerate(names)}


def admit_named(named: DataFrame, sites: DataFrame) -> DataFrame:
    """named (file, line, column) with the state of their site (site, outcome, stale): a fresh survivor is admitted, others say why not.  Of a place's sites the first decides."""
    first = sites.groupBy("file", "line", "column").agg(F.min(F.struct("site", "outcome", "stale")).alias("s")).select("file", "line", "column", F.lit(True).alias("there"), "s.outcome", "s.stale")
    rows = named.join(first, ["file", "line", "column"], "left")
    settled = F.concat(F.lit("not a survivor: "), F.coalesce("outcome", F.lit("not judged")))
    why = F.when(F.col("there").isNull(), "no such site").when(F.col("stale"), "stale").when(F.coalesce("outcome", F.lit("")) != "survived", settled).otherwise("admitted")
    return rows.withColumn("admission", why).drop("there")


def first_stop(findings: DataFrame) -> DataFrame:
    """The one finding that stops a run: stale exceptions, then uncovered mutants by file and line, then missing coverage."""
    rank = F.when(F.col("kind") == "stale exception", 0).when(F.col("kind") == "uncovered", 1).otherwise(2)
    return findings.withColumn("rank", rank).orderBy("rank", "file", "line").limit(1).drop("rank")


def site_states(sites: DataFrame) -> DataFrame:
    """sites (outcome, begun, after_stop) of a stopped run: completed, cancelled, blocked or unattempted."""
    return sites.withColumn("state", F.when(F.col("outcome").isNotNull(), "completed").when(F.col("begun"), "cancelled").when(F.col("after_stop"), "blocked").otherwise("unattempted"))


def proof(sites: DataFrame) -> DataFrame:
    """One row of tallies over judged sites (outcome); all NULL if none was judged."""
    judged = F.count_if(F.col("outcome").isin(*NOTICED, "survived"))
    of = {"killed": F.count_if(F.col("outcome").isin(*NOTICED)), "survived": F.count_if(F.col("outcome") == "survived"), "uncovered": F.count_if(F.col("outcome") == "uncovered"), "judged": judged}
    return sites.agg(*(F.when(judged > 0, c).alias(n) for n, c in of.items()))


def sample_agreement(trials: DataFrame, reruns: int = RERUNS) -> DataFrame:
    """How many of a sample's verdicts there are of each kind."""
    from loupe.operators.history import trial_verdicts

    return trial_verdicts(trials, reruns).groupBy("verdict").agg(F.count("*").alias("n"))
