"""Query catalogue over the star-schema tables: name -> query, name -> DuckDB SQL.

Each query drives one operator of the library with rows of the given tables in the shape the operator
takes; the SQL says the same in plain terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions import paths, scores
from loupe.operators import coverage, crap, graph, history, mutation, selection, similarity, testshape
from loupe.operators.tables import cut
from loupe.sources import reports
from loupe.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# --- complexity against coverage -------------------------------------------------------------------


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Parts as functions: as complex as they have suppliers, covered as far as their lines were returned."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("coverage"))
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"))
    return parts.join(lines, F.col("ord") == F.col("l_partkey"), "left").select("ord", "name", F.coalesce("n", F.lit(1)).cast("int").alias("complexity"), "coverage")


UNITS = """units AS (SELECT p_partkey AS ord, p_name AS name, CAST(coalesce(n, 1) AS INT) AS complexity, coverage FROM part LEFT JOIN
    (SELECT l_partkey, count(DISTINCT l_suppkey) AS n, count(*) FILTER (l_returnflag = 'R') / count(*) AS coverage FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey),
  scored AS (SELECT *, round(CAST(complexity AS DOUBLE) * complexity * (1 - coverage) * (1 - coverage) * (1 - coverage) + complexity, 2) AS crap FROM units),
  banded AS (SELECT *, CASE WHEN crap IS NULL THEN 'unknown' WHEN crap <= 5 THEN 'low' WHEN crap < 30 THEN 'medium' ELSE 'high' END AS band FROM scored)"""


@query(f"WITH {UNITS} SELECT ord, name, complexity, round(coverage, 9) AS coverage, crap, band FROM banded")
def q_crap_score(spark, d):
    return crap.score(_units(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query(f"WITH {UNITS} SELECT ord, name, complexity, crap FROM banded ORDER BY crap IS NULL, crap DESC, complexity DESC, ord LIMIT 20")
def q_crap_worst(spark, d):
    return crap.worst(crap.score(_units(spark, d)), 20).select("ord", "name", "complexity", "crap")


@query(f"WITH {UNITS} SELECT 'crap' AS rule, ord, crap FROM banded WHERE crap > 30")
def q_threshold_problems(spark, d):
    return crap.problems(crap.score(_units(spark, d)), 30).select("rule", "ord", "crap")


@query(f"""WITH {UNITS} SELECT 'crap' AS rule, 'p' || ord || ':' || (ord % 50) AS place, 'part#' || name AS detail, crap FROM scored WHERE crap > 6
  UNION ALL SELECT DISTINCT 'coverage', n_name, r_name || ': not measured', CAST(NULL AS DOUBLE) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 1""")
def q_crap_gate(spark, d):
    scored = crap.score(_units(spark, d)).select("ord", "name", "complexity", "crap", F.concat(F.lit("p"), "ord").alias("file"), (F.col("ord") % 50).alias("start_line"), F.lit("part").alias("namespace"))
    roots = table(spark, d, "nation").where("n_nationkey % 4 = 1").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return crap.gate(scored, 6.0, roots.select(F.col("n_name").alias("dir"), F.col("r_name").alias("language"), F.lit("not measured").alias("why")))


@query(f"WITH {UNITS} SELECT band, count(*) AS functions, max(crap) AS worst FROM banded GROUP BY band")
def q_bands(spark, d):
    return crap.score(_units(spark, d)).groupBy("band").agg(F.count("*").alias("functions"), F.max("crap").alias("worst"))


@query("""WITH u AS (SELECT c_custkey AS id, c_mktsegment AS language, CASE WHEN c_acctbal > 8000 AND c_mktsegment <> 'BUILDING' THEN 0.5::DOUBLE END AS coverage FROM customer)
  SELECT id, language, CASE WHEN coverage IS NULL AND language IN (SELECT language FROM u WHERE coverage IS NOT NULL) THEN 0.0::DOUBLE ELSE coverage END AS coverage FROM u""")
def q_unloaded_untested(spark, d):
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("language"), F.when((F.col("c_acctbal") > 8000) & (F.col("c_mktsegment") != "BUILDING"), 0.5).alias("coverage"))
    return crap.unloaded_as_untested(units).select("id", "language", "coverage")


# --- coverage ------------------------------------------------------------------------------------------


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as coverage segments of a file, from two reports told apart by line status."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.concat(F.lit("f"), F.col("l_orderkey")).alias("file"), (F.col("l_discount") > 0.08).alias("is_branch"), F.xxhash64("l_partkey", "l_suppkey", "l_linenumber").alias("ord"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"),
        F.lit(1.0).alias("total"), (F.col("l_quantity") > 25).cast("double").alias("covered"), F.when(F.col("l_tax") < 0.01, "").otherwise(F.col("l_linenumber").cast("string")).alias("key"), (F.col("l_quantity") > 25).alias("ran"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("from_mask"),
    )


SEGMENTS = """segments AS (SELECT 'f' || l_orderkey AS file, l_discount > 0.08 AS is_branch, l_linenumber AS start, l_linenumber + 1 AS "end", 1.0 AS total, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS covered,
    CASE WHEN l_tax < 0.01 THEN '' ELSE CAST(l_linenumber AS VARCHAR) END AS key, l_quantity > 25 AS ran, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS from_mask FROM lineitem)"""


@query(f"""WITH {SEGMENTS} SELECT file, is_branch, key, CAST(max(covered) AS DOUBLE) AS covered, bool_or(ran) AS ran, bit_or(from_mask) AS from_mask FROM segments WHERE key <> '' GROUP BY ALL
  UNION ALL SELECT file, is_branch, key, CAST(covered AS DOUBLE), ran, from_mask FROM segments WHERE key = ''""")
def q_segment_merge(spark, d):
    return coverage.merge_segments(_segments(spark, d)).select("file", "is_branch", "key", "covered", "ran", "from_mask")


RANGES = """ranges AS (SELECT 'f' || o_orderkey AS file, o_orderkey AS id, 1 + o_orderkey % 3 AS low, 1 + o_orderkey % 3 + 2 AS high FROM orders)"""


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    low = 1 + F.col("o_orderkey") % 3
    return table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey")).alias("file"), F.col("o_orderkey").alias("id"), low.alias("low"), (low + 2).alias("high"))


@query(f"""WITH {SEGMENTS}, {RANGES}, hit AS (SELECT file, id, is_branch, total, covered FROM ranges JOIN segments USING (file) WHERE start BETWEEN low AND high AND NOT (start = low + 1 AND id % 5 = 0)),
  s AS (SELECT file, id, sum(total) FILTER (is_branch) AS bt, sum(covered) FILTER (is_branch) AS bc, sum(total) FILTER (NOT is_branch) AS lt, sum(covered) FILTER (NOT is_branch) AS lc FROM hit GROUP BY file, id)
  SELECT file, id, round(CAST(CASE WHEN bt > 0 THEN bc / bt WHEN lt > 0 THEN lc / lt END AS DOUBLE), 9) AS share FROM ranges LEFT JOIN s USING (file, id)""")
def q_range_share(spark, d):
    ranges = _ranges(spark, d)
    skip = ranges.where("id % 5 = 0").select("file", "id", (F.col("low") + 1).alias("skip_low"), (F.col("low") + 1).alias("skip_high"))
    return coverage.range_share(ranges, _segments(spark, d), skip).select("file", "id", F.round("share", 9).alias("share"))


@query(f"""WITH {SEGMENTS}, lines AS (SELECT DISTINCT file, start AS line FROM segments),
  m AS (SELECT l.file, line, bool_or(ran) AS executed, bit_or(CASE WHEN ran THEN from_mask ELSE 0 END) AS mask FROM lines l JOIN segments s ON l.file = s.file AND line BETWEEN start AND "end" GROUP BY ALL)
  SELECT file, line, executed, mask & 1 > 0 AS in_process, mask & 2 > 0 AS integration FROM m""")
def q_line_sources(spark, d):
    segments = _segments(spark, d)
    return coverage.line_sources(segments.select("file", F.col("start").alias("line")).distinct(), segments)


@query("""WITH e AS (SELECT 'u' || user_id AS file, event_id AS id, event_id AS line, event_id - 2000 AS statement, event_type FROM events)
  SELECT s.file, s.id, coalesce(max(m.line), any_value(s.line)) AS measured_line FROM e s LEFT JOIN (SELECT * FROM e WHERE event_type IN ('click', 'view', 'purchase')) m ON s.file = m.file AND m.line BETWEEN s.statement AND s.line GROUP BY s.file, s.id""")
def q_site_line_asof(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("file"), F.col("event_id").alias("id"), F.col("event_id").alias("line"), (F.col("event_id") - 2000).alias("statement"), "event_type")
    measured = e.where(F.col("event_type").isin("click", "view", "purchase"))
    return coverage.site_line(e, measured).select("file", "id", "measured_line")


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://[^/]*/', '') AS u FROM pages),
  r AS (SELECT DISTINCT CASE length(u) % 4 WHEN 0 THEN u WHEN 1 THEN 'C:\w\' || replace(u, '/', '\') WHEN 2 THEN 'file:///mnt/src/' || u ELSE './a/../b/' || u END AS path FROM p),
  src AS (SELECT DISTINCT prefix || u AS source FROM p, (VALUES ('src/', 2), ('lib/', 3), ('', 5), ('/mnt/src/', 7), ('src/b/', 9)) v(prefix, k) WHERE length(u) % k = 0),
  c AS (SELECT path, CASE WHEN path LIKE './a%' THEN substr(path, 8) ELSE replace(replace(path, 'file://', ''), '\', '/') END AS clean FROM r),
  w AS (SELECT path, clean, string_split(rtrim(clean, '/'), '/') AS parts FROM c),
  src2 AS (SELECT source, rtrim(source, '/') AS spot FROM src),
  n AS (SELECT path, i, CASE WHEN i = 1 AND clean LIKE '/%' THEN rtrim(clean, '/') ELSE 'src/' || array_to_string(list_filter(parts[i:], lambda x: x <> ''), '/') END AS spot FROM (SELECT path, clean, parts, unnest(range(1, len(parts) + 1)) AS i FROM w)),
  named AS (SELECT path, arg_min(source, (i, source)) AS source FROM n JOIN src2 USING (spot) GROUP BY path),
  t AS (SELECT path, source, list_reverse(parts) AS a, list_reverse(string_split(spot, '/')) AS b FROM w JOIN src2 ON parts[-1] = split_part(spot, '/', -1) WHERE path NOT IN (SELECT path FROM named)),
  s AS (SELECT path, source, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS tail FROM t),
  best AS (SELECT path, source, tail, max(tail) OVER (PARTITION BY path) AS top FROM s), alone AS (SELECT path, min(source) AS source FROM best WHERE tail = top GROUP BY path HAVING count(*) = 1)
  SELECT path, coalesce(named.source, alone.source) AS source FROM r LEFT JOIN named USING (path) LEFT JOIN alone USING (path)""")
def q_path_tail_match(spark, d):
    u, size = F.col("u"), F.length("u")
    p = table(spark, d, "pages").select(F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^[a-z]+://[^/]*/", "").alias("u")).distinct()
    windows = F.concat(F.lit("C:\\w\\"), F.translate(u, "/", "\\"))
    reported = p.select(F.when(size % 4 == 0, u).when(size % 4 == 1, windows).when(size % 4 == 2, F.concat(F.lit("file:///mnt/src/"), u)).otherwise(F.concat(F.lit("./a/../b/"), u)).alias("path"))
    prefixes = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(k).alias("k")) for a, k in (("src/", 2), ("lib/", 3), ("", 5), ("/mnt/src/", 7), ("src/b/", 9))))
    sources = p.select("u", F.explode(prefixes).alias("v")).where(size % F.col("v.k") == 0).select(F.concat("v.a", "u").alias("path"))
    return coverage.match_paths(reported, sources, "src")


@query("""SELECT 'f' || l_orderkey AS file, l_linenumber AS start, l_quantity > 25 AS ran, 1.0::DOUBLE AS total FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem)""")
def q_lcov_parse(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct()
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda x: F.concat(F.lit("DA:"), x["l_linenumber"], F.lit(","), F.when(x["l_quantity"] > 25, "7").otherwise("0"))), "\n")
    text = rows.groupBy(F.col("l_orderkey").alias("report")).agg(body.alias("body")).select("report", F.concat(F.lit("TN:\nSF:f"), F.col("report"), F.lit("\n"), F.col("body"), F.lit("\nend_of_record\n")).alias("text"))
    return reports.read_lcov(text).select("file", "start", "ran", "total")


@query("""SELECT 'm/f' || l_orderkey || '.go' AS file, l_linenumber AS start, l_linenumber + 2 AS "end", CAST(CAST(l_quantity AS INT) AS DOUBLE) AS total, CASE WHEN l_discount > 0.05 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) ELSE 0.0 END AS covered FROM lineitem""")
def q_cover_parse(spark, d):
    line = F.format_string("m/f%d.go:%d.2,%d.7 %d %d", "l_orderkey", "l_linenumber", F.col("l_linenumber") + 2, F.col("l_quantity").cast("int"), (F.col("l_discount") > 0.05).cast("int"))
    text = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report"), F.concat(F.lit("mode: count\n"), line, F.lit("\n")).alias("text"))
    return reports.read_go_cover(text).select("file", "start", "end", "total", "covered")


@query("""SELECT 'f' || l_orderkey AS file, l_linenumber * 10 AS start, CASE WHEN CAST(l_quantity AS INT) % 4 = 0 THEN l_linenumber * 10 + 1 ELSE l_linenumber * 10 + CAST(l_quantity AS INT) % 4 - 1 END AS "end", CAST(l_quantity AS INT) % 4 = 0 AS deletion FROM lineitem""")
def q_diff_hunks(spark, d):
    hunk = F.format_string("@@ -%d,2 +%d,%d @@ context", "l_linenumber", F.col("l_linenumber") * 10, F.col("l_quantity").cast("int") % 4)
    head = F.format_string("diff --git a/f%d b/f%d\nindex 1..2 100644\n--- a/f%d\n+++ b/f%d\n", *["l_orderkey"] * 4)
    text = table(spark, d, "lineitem").select(F.monotonically_increasing_id().alias("report"), F.concat(head, hunk, F.lit("\n+++ b/not a header\n+x\n")).alias("text"))
    return reports.read_diff(text)


@query("""SELECT o_orderkey AS id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber <= 2 + o_orderkey % 3 AND l_linenumber + 1 >= 2 + o_orderkey % 2)""")
def q_overlap(spark, d):
    units = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderkey").alias("id"), (2 + F.col("o_orderkey") % 2).alias("start_line"), (2 + F.col("o_orderkey") % 3).alias("end_line"))
    ranges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end"))
    return selection.touched(units, ranges).select("id")


# --- similarity ----------------------------------------------------------------------------------------


def _word_sets(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    # a generator of one row keeps the filter from splitting each text again
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), F.explode(F.array(words)).alias("tokens")).where("size(tokens) >= 20")


WORDS = r"""sets AS (SELECT id, part, tokens, len(tokens) AS n FROM (SELECT doc_id AS id, lang AS part, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')) AS tokens FROM documents WHERE text IS NOT NULL) WHERE len(tokens) >= 20),
  t AS (SELECT id, part, n, unnest(tokens) AS w FROM sets),
  pairs AS (SELECT x.id AS a, y.id AS b, x.part AS part, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS score FROM t x JOIN t y ON x.w = y.w AND x.part = y.part AND x.id < y.id GROUP BY ALL HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.82)"""


@query(f"WITH {WORDS} SELECT a, b, part, round(score, 6) AS score FROM pairs")
def q_dry_pairs(spark, d):
    return similarity.similar_pairs(_word_sets(spark, d), 0.82).select("a", "b", "part", F.round("score", 6).alias("score"))


@query(f"WITH {WORDS} SELECT a, b, round(score, 6) AS score FROM pairs WHERE a % 10 = 0 OR b % 10 = 0")
def q_dry_focus(spark, d):
    docs = _word_sets(spark, d)
    return similarity.similar_pairs(docs, 0.82, docs.where("id % 10 = 0")).select("a", "b", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {WORDS}, links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT a AS id, a AS other FROM links UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
  roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)
  SELECT root, (SELECT count(*) FROM roots r WHERE r.root = g.root) AS size, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score FROM (SELECT root, score FROM pairs JOIN roots ON a = id) g GROUP BY root""")
def q_dry_groups(spark, d):
    links = similarity.with_copies(*similarity.similar_classes(_word_sets(spark, d), 0.82))
    return similarity.groups(links).select("root", "size", F.round("min_score", 6).alias("min_score"), F.round("max_score", 6).alias("max_score"))


@query("SELECT * FROM (VALUES ('both', 1.0::DOUBLE), ('one', 0.0::DOUBLE), ('half', round(1 / 3, 6)::DOUBLE)) AS t(kind, score)")
def q_set_jaccard_empty(spark, d):
    rows = spark.createDataFrame([("both", [], []), ("one", [], [1]), ("half", [1, 2], [2, 3])], "kind string, a array<int>, b array<int>")
    return rows.select("kind", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("score"))


# --- test structure --------------------------------------------------------------------------------------


def _examples(spark: SparkSession, d: str) -> DataFrame:
    """Turns as examples of a conversation: lines from length, decisions from questions, assertions from full stops, mocks from commas."""
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c)))
    return table(spark, d, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("file"), F.col("turn").alias("ord"), F.col("role").alias("group"), F.concat_ws("-", "role", "turn").alias("name"), F.floor(F.length("text") / 20).cast("int").alias("lines"),
        (count("Q")).alias("decisions"), F.floor(count(",") / 2).cast("int").alias("mocks"), count(".").alias("assertions"),
    )


EXAMPLES = """ex AS (SELECT 'c' || conv_id AS file, turn AS ord, role AS grp, role || '-' || turn AS name, CAST(length(text) // 20 AS INT) AS lines, length(text) - length(replace(text, 'Q', '')) AS decisions,
    (length(text) - length(replace(text, ',', ''))) // 2 AS mocks, length(text) - length(replace(text, '.', '')) AS assertions FROM conversations),
  sc AS (SELECT *, round(1.0::DOUBLE + greatest(0, lines - 15) / 5 + 2.5::DOUBLE * decisions + 1.5::DOUBLE * greatest(0, mocks - 2) + CASE WHEN assertions = 0 THEN 6 ELSE 0 END + greatest(0, assertions - 10) / 2, 1) AS score FROM ex)"""


@query(f"WITH {EXAMPLES} SELECT file, ord, score FROM sc")
def q_scrap_score(spark, d):
    return testshape.scored(_examples(spark, d)).select("file", "ord", "score")


@query(f"""WITH {EXAMPLES} SELECT file, ord, array_to_string(list_filter([CASE WHEN assertions = 0 THEN 'no-assertions' END, CASE WHEN lines > 30 THEN 'large' END, CASE WHEN decisions > 0 THEN 'logic' END, CASE WHEN mocks >= 3 THEN 'mock-heavy' END,
  CASE WHEN assertions > 10 THEN 'assertion-heavy' END], lambda x: x IS NOT NULL), ',') AS smells FROM sc""")
def q_scrap_smells(spark, d):
    return testshape.scored(_examples(spark, d)).select("file", "ord", F.array_join("smells", ",").alias("smells"))


CLUSTERS = """cl AS (SELECT file, CASE WHEN ord % 2 = 0 THEN 'table' ELSE 'duplication' END AS kind, 0.8 + 0.05 * (ord % 3) AS similarity, 3 AS size FROM ex WHERE ord < 2 AND lines > 20),
  weighed AS (SELECT file, sum(CASE WHEN kind = 'table' THEN 0.5 WHEN similarity >= 0.85 THEN 2.0 ELSE 0.0 END * (size - 1)) AS shared, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind <> 'table' AND similarity >= 0.85) AS dups FROM cl GROUP BY file),
  sums AS (SELECT file, count(*) AS examples, round(avg(score), 1) AS average_score, max(score) AS max_score, sum(score - 1) AS own, count(*) FILTER (score >= 6 OR assertions = 0) AS hot, count(DISTINCT grp) FILTER (score >= 6 OR assertions = 0) AS hot_groups, count(*) FILTER (mocks >= 3) AS mocked FROM sc GROUP BY file)"""


@query(f"""WITH {EXAMPLES}, {CLUSTERS} SELECT file, examples, max_score, round(CAST(own + coalesce(shared, 0) AS DOUBLE), 1) AS pressure, CASE WHEN examples >= 25 AND hot_groups >= 3 AND hot >= 5 THEN 'MANUAL_SPLIT' WHEN examples >= 4 AND mocked * 2 > examples THEN 'REVIEW_FIRST'
  WHEN hot > 0 OR coalesce(dups, 0) > 0 THEN 'AUTO_REFACTOR' WHEN coalesce(tables, 0) > 0 THEN 'AUTO_TABLE_DRIVE' ELSE 'LEAVE_ALONE' END AS action FROM sums LEFT JOIN weighed USING (file)""")
def q_scrap_action(spark, d):
    details = testshape.scored(_examples(spark, d))
    clusters = details.where("ord < 2 AND lines > 20").select("file", F.when(F.col("ord") % 2 == 0, "table").otherwise("duplication").alias("kind"), (0.8 + 0.05 * (F.col("ord") % 3)).alias("similarity"), F.lit(3).alias("size"))
    return testshape.file_reports(details, clusters).select("file", "examples", "max_score", "pressure", "action")


@query(f"""WITH {EXAMPLES}, adv AS (SELECT file, ord, name, unnest([{{'at': 0, 'r': 0, 'c': 'HIGH', 'advice': CASE WHEN assertions = 0 THEN 'no-assertions' END}}, {{'at': 1, 'r': 0, 'c': 'HIGH', 'advice': CASE WHEN lines > 30 THEN 'large' END}},
  {{'at': 2, 'r': 1, 'c': 'MEDIUM', 'advice': CASE WHEN decisions > 0 THEN 'logic' END}}, {{'at': 3, 'r': 1, 'c': 'MEDIUM', 'advice': CASE WHEN mocks >= 3 THEN 'mock-heavy' END}}, {{'at': 4, 'r': 1, 'c': 'MEDIUM', 'advice': CASE WHEN assertions > 10 THEN 'assertion-heavy' END}}]) AS x FROM sc),
  ranked AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY x.r, ord, x.at) AS nth, x.c AS confidence, name, x.advice AS advice FROM adv WHERE x.advice IS NOT NULL) SELECT file, CAST(nth AS INT) AS nth, confidence, name, advice FROM ranked WHERE nth <= 10""")
def q_scrap_recommend(spark, d):
    return testshape.recommendations(testshape.scored(_examples(spark, d)))


@query("""WITH s AS (SELECT conv_id * 1000 + turn AS id, conv_id AS part, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')) AS tokens FROM conversations WHERE text IS NOT NULL), t AS (SELECT id, part, len(tokens) AS n, unnest(tokens) AS w FROM s)
  SELECT x.id AS a, y.id AS b, x.part AS part, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS score FROM t x JOIN t y ON x.part = y.part AND x.w = y.w AND x.id < y.id GROUP BY ALL HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.05""")
def q_scrap_pairs(spark, d):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    sets = table(spark, d, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("part"), words.alias("tokens"))
    return similarity.similar_pairs(sets, 0.05).select("a", "b", "part", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE {EXAMPLES}, s AS (SELECT ord + 1000 * CAST(file[2:] AS BIGINT) AS id, file, lines, decisions, list_distinct(list_filter(string_split(lower(text), ''), lambda c: c <> ' ' AND c <> chr(10))) AS tokens, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS nodes
      FROM ex JOIN conversations ON file = 'c' || conv_id AND ord = turn WHERE text IS NOT NULL),
  t AS (SELECT id, file, len(tokens) AS n, unnest(tokens) AS w FROM s), j AS (SELECT x.file AS file, x.id AS a, y.id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS score FROM t x JOIN t y ON x.file = y.file AND x.w = y.w AND x.id < y.id GROUP BY ALL),
  e AS (SELECT a, b FROM j WHERE score >= 0.7 UNION ALL SELECT b, a FROM j WHERE score >= 0.7), r AS (SELECT a AS id, a AS to_id FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.to_id = e.a), g AS (SELECT id, min(to_id) AS root FROM r GROUP BY id),
  m AS (SELECT root, count(*) AS size, any_value(file) AS file, bool_and(lines <= 12 AND decisions = 0) AS plain, sum(nodes) // count(*) AS nodes FROM g JOIN s USING (id) GROUP BY root),
  sim AS (SELECT x.root AS root, sum(score) AS total FROM j JOIN g x ON j.a = x.id JOIN g y ON j.b = y.id AND x.root = y.root GROUP BY x.root)
  SELECT file, root, size, round(total / (size * (size - 1) / 2), 6) AS similarity, CASE WHEN plain AND size >= 3 AND total / (size * (size - 1) / 2) >= 0.85 THEN 'table' WHEN nodes >= 40 THEN 'duplication' END AS kind FROM m JOIN sim USING (root)
  WHERE nodes >= 40 OR plain AND size >= 3 AND total / (size * (size - 1) / 2) >= 0.85""")
def q_scrap_clusters(spark, d):
    """Turns as examples, the letters of a text as its syntax: whole clusters of a conversation, with mean similarity and kind."""
    letters = F.array_distinct(F.filter(F.split(F.lower("text"), ""), lambda c: ~c.isin("", " ", "\n")))
    texts = table(spark, d, "conversations").where("text IS NOT NULL").select(F.concat(F.lit("c"), F.col("conv_id")).alias("file"), F.col("turn").alias("ord"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), letters.alias("tokens"), F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("nodes"))
    sets = texts.join(_examples(spark, d).select("file", "ord", "lines", "decisions"), ["file", "ord"]).withColumn("is_table", F.lit(False)).withColumn("part", F.col("file"))
    return testshape.clusters(sets).select("file", "root", "size", F.round("similarity", 6).alias("similarity"), "kind")


@query("""WITH p AS (SELECT source, round(sum(n_chars) / 1000.0::DOUBLE, 1) AS pressure FROM documents WHERE doc_id % 2 = 0 GROUP BY source), c AS (SELECT source, round(sum(n_chars) / 1000.0::DOUBLE, 1) AS pressure FROM documents WHERE doc_id % 2 = 1 GROUP BY source)
  SELECT source AS file, round(CAST(c.pressure - p.pressure AS DOUBLE), 1) AS delta, CASE WHEN p.pressure IS NULL THEN NULL WHEN round(CAST(c.pressure - p.pressure AS DOUBLE), 1) <= -0.5 THEN 'improved' WHEN round(CAST(c.pressure - p.pressure AS DOUBLE), 1) >= 0.5 THEN 'worse' ELSE 'unchanged' END AS verdict FROM c LEFT JOIN p USING (source)""")
def q_compare_runs(spark, d):
    rows = table(spark, d, "documents").groupBy((F.col("doc_id") % 2).alias("run"), F.col("source").alias("file")).agg(scores.rounded(F.sum("n_chars") / 1000.0).alias("pressure"))
    return history.compare_runs(rows.where("run = 0"), rows.where("run = 1")).select("file", "delta", "verdict")


# --- graphs --------------------------------------------------------------------------------------------


@query(r"""SELECT DISTINCT url, CASE WHEN starts_with(p, '/') THEN '/' || array_to_string(list_transform(string_split(regexp_replace(regexp_replace(p, '/$', ''), '^/', ''), '/'), lambda s: CASE WHEN regexp_matches(s, '^(\{.*\}|:.+|<.+>|\*.*)$') OR contains(s, '{}') THEN '*' ELSE s END), '/') END AS route
  FROM (SELECT url, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', '') AS p FROM pages)""")
def q_http_routes(spark, d):
    return table(spark, d, "pages").select("url", paths.normalise_route(F.col("url")).alias("route")).distinct()


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, d, "pages").select("page_id", paths.normalise_route(F.col("url")).alias("path")).where("path IS NOT NULL").where(paths.has_literal(F.col("path")))
    method = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.when(F.col("page_id") % 3 == 1, "GET").otherwise("POST"))
    named = pages.select(F.concat(F.lit("m"), F.col("page_id") % 20).alias("module"), method.alias("method"), "path", "page_id")
    serves = named.where("page_id % 7 = 0").withColumn("path", F.regexp_replace("path", "/[0-9]+", "/*"))
    return named.where("page_id % 7 <> 0").drop("page_id"), serves.drop("page_id")


@query(r"""WITH p AS (SELECT page_id, '/' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', ''), '/$', ''), '^/', '') AS path FROM pages WHERE starts_with(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '[?#].*$', ''), '/')),
  n AS (SELECT 'm' || page_id % 20 AS module, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'GET' ELSE 'POST' END AS method, path, page_id FROM p WHERE len(list_filter(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: s <> '*' AND s <> '')) > 0),
  c AS (SELECT module, method, string_split(path, '/') AS s FROM n WHERE page_id % 7 <> 0), v AS (SELECT module, method, regexp_replace(path, '/[0-9]+', '/*', 'g') AS route, string_split(regexp_replace(path, '/[0-9]+', '/*', 'g'), '/') AS s FROM n WHERE page_id % 7 = 0)
  SELECT c.module AS src, v.module AS dst, count(*) AS count, string_agg(DISTINCT trim(v.method || ' ' || v.route), ', ' ORDER BY trim(v.method || ' ' || v.route)) AS via FROM c JOIN v ON len(c.s) = len(v.s) AND c.module <> v.module AND (c.method = '' OR v.method = '' OR c.method = v.method)
  AND len(list_filter(range(1, len(c.s) + 1), lambda i: c.s[i] <> v.s[i] AND c.s[i] <> '*' AND v.s[i] <> '*')) = 0 GROUP BY ALL""")
def q_http_edges(spark, d):
    return graph.http_edges(*_requests(spark, d))


ROLL = """u AS (SELECT r_name AS r, r_name || '/' || n_name AS n, r_name || '/' || n_name || '/' || c_mktsegment AS m, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(c_acctbal / 200, 1) END AS crap, c_custkey % 5 AS killed, c_custkey % 3 AS survived, c_custkey % 2 AS uncovered,
    CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS stale, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 0 END AS duplicates FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  steps AS (SELECT m AS node, true AS module, * FROM u UNION ALL SELECT n, false, * FROM u UNION ALL SELECT r, false, * FROM u UNION ALL SELECT '(root)', false, * FROM u),
  g AS (SELECT node, bool_or(module) AS module, count(*) AS functions, count(*) FILTER (crap <= 5) AS low, count(*) FILTER (crap > 5 AND crap < 30) AS medium, count(*) FILTER (crap >= 30) AS high, count(*) FILTER (crap IS NULL) AS unknown, max(crap) AS max_crap,
    sum(killed)::BIGINT AS killed, sum(survived)::BIGINT AS survived, sum(uncovered)::BIGINT AS uncovered, sum(stale)::BIGINT AS stale, sum(duplicates)::BIGINT AS duplicates FROM steps GROUP BY node),
  h AS (SELECT *, CASE WHEN module AND max_crap IS NOT NULL THEN CASE WHEN max_crap <= 5 THEN 10.0 WHEN max_crap >= 30 THEN 1.0 ELSE round(10 - 9 * (max_crap - 5) / 25, 1) END WHEN low + medium + high > 0 THEN round(10 - 9 * least(1.0::DOUBLE, 2 * ((high + 0.3::DOUBLE * medium) / (low + medium + high))), 1) END::DOUBLE AS crap_grade,
    CASE WHEN killed + survived > 0 THEN round(1 + 9 * killed / (killed + survived), 1) END::DOUBLE AS mutation_grade FROM g)"""


def _roll(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    return graph.roll_up(c.select(F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"), F.when(F.col("c_acctbal") >= 0, F.round(F.col("c_acctbal") / 200, 1)).alias("crap"), (key % 5).alias("killed"), (key % 3).alias("survived"), (key % 2).alias("uncovered"), (key % 7 == 0).cast("int").alias("stale"), F.when(key % 11 == 0, 2).otherwise(0).alias("duplicates")))


@query(f"WITH {ROLL} SELECT node, functions, low, medium, high, unknown, max_crap, killed, survived, uncovered, stale, duplicates FROM g")
def q_rollup(spark, d):
    return _roll(spark, d).drop("module", "crap_grade", "mutation_grade", "grade")


@query(f"WITH {ROLL} SELECT node, crap_grade, mutation_grade, CASE WHEN crap_grade IS NOT NULL AND mutation_grade IS NOT NULL THEN round((crap_grade + mutation_grade) / 2, 1) ELSE coalesce(crap_grade, mutation_grade) END AS grade FROM h")
def q_grades(spark, d):
    return _roll(spark, d).select("node", "crap_grade", "mutation_grade", "grade")


@query("""WITH i AS (SELECT 'n' || c_nationkey AS src, 's' || o_custkey % 40 AS target FROM orders JOIN customer ON o_custkey = c_custkey), x AS (SELECT 's' || s_suppkey AS target, arg_max('n' || s_nationkey, s_suppkey) AS module FROM supplier WHERE s_suppkey < 30 GROUP BY 1)
  SELECT src, coalesce(module, 'external:' || target) AS dst, module IS NULL AS external, count(*) AS count FROM i LEFT JOIN x USING (target) WHERE src <> coalesce(module, 'external:' || target) GROUP BY ALL""")
def q_import_edges(spark, d):
    imports = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("n"), F.col("c_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("o_custkey") % 40).alias("target"))
    index = table(spark, d, "supplier").where("s_suppkey < 30").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("target"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("module"), F.col("s_suppkey").alias("ord"))
    return graph.module_edges(imports, index)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Parts as modules in packages of 50; each imports a module of its own package, and some import each other in rounds."""
    k = F.col("p_partkey")
    dst = F.when(k % 4 == 0, k - 3).when(k % 9 == 0, k + 30).otherwise(k + 1)
    return table(spark, d, "part").select(k.alias("src"), dst.alias("dst")).where("src div 50 = dst div 50")


EDGES = """edges AS (SELECT src, dst FROM (SELECT p_partkey AS src, CASE WHEN p_partkey % 4 = 0 THEN p_partkey - 3 WHEN p_partkey % 9 = 0 THEN p_partkey + 30 ELSE p_partkey + 1 END AS dst FROM part) WHERE src // 50 = dst // 50)"""


@query(f'WITH RECURSIVE {EDGES}, r AS (SELECT src AS start, src AS node FROM edges UNION SELECT start, dst FROM r JOIN edges ON node = src) SELECT start, node FROM r')
def q_reach(spark, d):
    edges = _edges(spark, d)
    return graph.reach(edges.select("src"), edges)


@query(f"WITH {EDGES} SELECT src AS start, src AS node FROM edges UNION SELECT src, dst FROM edges")
def q_reach_onehop(spark, d):
    edges = _edges(spark, d)
    return graph.reach(edges.select("src"), edges, hops=1)


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM r JOIN edges e ON r.dst = e.src), m AS (SELECT a.src AS node, a.dst AS other FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
  SELECT node, least(node, min(other)) AS cycle FROM m GROUP BY node""")
def q_scc(spark, d):
    return graph.cycles(_edges(spark, d))


@query(f"WITH RECURSIVE {EDGES}, l AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT a AS node, a AS other FROM l UNION SELECT node, b FROM r JOIN l ON other = a) SELECT node, min(other) AS root FROM r GROUP BY node")
def q_components(spark, d):
    return graph.components(_edges(spark, d))


@query("""WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
  SELECT a.n_regionkey AS from_box, b.n_regionkey AS to_box, sum(count)::BIGINT AS count, count(*) AS pairs FROM e JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY ALL""")
def q_view_contract(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = x.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("count"))
    return graph.contract(edges, table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("box")))


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', '') AS path FROM pages), m AS (SELECT DISTINCT split_part(path, '/', 1) AS marker FROM p WHERE length(path) % 3 = 0 UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE length(path) % 5 = 0)
  SELECT path, (SELECT max_by(marker, length(marker)) FROM m WHERE path = marker OR starts_with(path, marker || '/')) AS marker FROM p""")
def q_nearest_marker(spark, d):
    path = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^[a-z]+://", "")
    p = table(spark, d, "pages").select(path.alias("path")).distinct()
    part = lambda n: F.split_part("path", F.lit("/"), F.lit(n))
    markers = p.where("length(path) % 3 = 0").select(part(1).alias("marker")).union(p.where("length(path) % 5 = 0").select(F.concat_ws("/", part(1), part(2)))).distinct()
    return graph.nearest_prefix(p, markers)


# --- history -------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS occurrence FROM conversations WHERE turn % 3 <> 2), b AS (SELECT conv_id, role, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS occurrence FROM conversations WHERE turn % 4 <> 1)
  SELECT a.conv_id, a.role, CAST(occurrence AS INT) AS occurrence, a.turn AS turn, b.turn AS turn_recorded FROM a LEFT JOIN b USING (conv_id, role, occurrence)""")
def q_occurrence_join(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "role", "turn")
    return history.occurrence_join(c.where("turn % 3 <> 2"), c.where("turn % 4 <> 1"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "occurrence", "turn", "turn_recorded")


PAIRED = """r AS (SELECT l_orderkey AS id, l_linenumber AS ord, min(l_returnflag) AS hash FROM lineitem GROUP BY ALL), m AS (SELECT id, ord, CASE WHEN ord % 3 = 0 THEN 'X' ELSE hash END AS hash FROM r),
  o AS (SELECT *, row_number() OVER (PARTITION BY id, hash ORDER BY ord) AS k FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY id, hash ORDER BY ord) AS k FROM m), s AS (SELECT id, o.ord AS old_ord, n.ord AS new_ord FROM o JOIN n USING (id, hash, k)),
  ro AS (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = o.id AND old_ord = ord)), rn AS (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = n.id AND new_ord = ord))"""


@query(f"WITH {PAIRED} SELECT id, old_ord, new_ord, true AS same_hash FROM s UNION ALL SELECT id, ro.ord, rn.ord, false FROM ro JOIN rn USING (id, k)")
def q_pair_by_hash(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ord")).agg(F.min("l_returnflag").alias("hash"))
    return history.pair_by_hash(rows, rows.withColumn("hash", F.when(F.col("ord") % 3 == 0, "X").otherwise(F.col("hash"))))


DIFF = """d AS (SELECT key, CASE WHEN h THEN w END AS was, CASE WHEN g THEN n END AS now, h, g FROM (SELECT doc_id AS key, sha256(coalesce(text, '')) AS w, CASE WHEN doc_id % 10 = 0 THEN sha256(coalesce(text, '') || '!') ELSE sha256(coalesce(text, '')) END AS n, doc_id % 3 <> 0 AS h, doc_id % 4 <> 0 AS g FROM documents) WHERE h OR g),
  st AS (SELECT key, CASE WHEN NOT h THEN 'added' WHEN NOT g THEN 'removed' WHEN was = now THEN 'same' ELSE 'changed' END AS state FROM d)"""


def _diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    old = docs.where("key % 3 <> 0").select("key", F.sha2("text", 256).alias("hash"))
    new = docs.where("key % 4 <> 0").select("key", F.when(F.col("key") % 10 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return history.hash_diff(old, new)


@query(f"WITH {DIFF} SELECT key, state FROM st")
def q_hash_diff(spark, d):
    return _diff(spark, d)


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def q_orphans(spark, d):
    present = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return history.orphans(table(spark, d, "orders"), present, ["o_custkey"]).select("o_orderkey")


@query(f"""WITH {DIFF} SELECT key, CASE WHEN state = 'added' THEN 'missing' WHEN state = 'changed' THEN 'stale: code' WHEN quality = 0 THEN 'stale: tests' WHEN toxic = 1 THEN 'stale: marked' WHEN key % 17 = 0 THEN 'stale: listed' WHEN key % 19 = 0 THEN 'stale: suite' WHEN key % 23 = 0 THEN 'stale: unrecorded' ELSE 'fresh' END AS state
  FROM st LEFT JOIN labels ON key = doc_id WHERE state <> 'removed'""")
def q_freshness(spark, d):
    rows = _diff(spark, d).where("state <> 'removed'").join(table(spark, d, "labels").withColumnRenamed("doc_id", "key"), "key", "left")
    key = F.col("key")
    why = history.freshness(F.col("state") == "added", F.col("state") == "changed", F.col("quality") == 0, F.col("toxic") == 1, key % 17 == 0, key % 19 == 0, key % 23 == 0)
    return rows.select("key", why.alias("state"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber AND r.l_discount > 0.03)")
def q_sites_unrecorded(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return history.orphans(x, x.where("l_discount > 0.03"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


OUTCOME = "CASE event_id % 5 WHEN 0 THEN 'killed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'survived' WHEN 3 THEN 'uncovered' ELSE 'skipped' END"


@query("""WITH m AS (SELECT l_orderkey AS unit, l_linenumber AS key, CASE l_returnflag WHEN 'R' THEN 'killed' WHEN 'A' THEN 'survived' ELSE 'uncovered' END AS outcome, l_suppkey % 10 = 0 AS flaky, l_linenumber AS line FROM lineitem),
  s AS (SELECT l_orderkey AS unit, l_linenumber AS key, max(1000 + l_partkey) AS line FROM lineitem WHERE l_discount > 0.03 GROUP BY ALL), h AS (SELECT o_orderkey AS unit, o_custkey % 4 > 0 AS held FROM orders),
  k AS (SELECT m.*, h.held, s.line AS site_line, NOT held OR s.key IS NOT NULL AS kept FROM m JOIN h USING (unit) LEFT JOIN s USING (unit, key))
  SELECT unit, count(key) FILTER (kept) AS sites, count(key) FILTER (kept AND NOT flaky AND outcome = 'killed') AS killed, count(key) FILTER (kept AND NOT flaky AND outcome = 'survived') AS survived, count(key) FILTER (kept AND NOT flaky AND outcome = 'uncovered') AS uncovered,
    count(key) FILTER (kept) AS mutants, CAST(coalesce(sum(CASE WHEN held THEN site_line ELSE line END) FILTER (kept), 0) AS BIGINT) AS lines FROM k GROUP BY unit""")
def q_on_sites(spark, d):
    """Lines as recorded mutants of their orders, those with a larger discount as sites that are still there; of every fourth customer the code changed."""
    outcome = F.when(F.col("l_returnflag") == "R", "killed").when(F.col("l_returnflag") == "A", "survived").otherwise("uncovered")
    line = table(spark, d, "lineitem").withColumnsRenamed({"l_orderkey": "unit", "l_linenumber": "key"})
    mutants = line.select("unit", "key", outcome.alias("outcome"), (F.col("l_suppkey") % 10 == 0).alias("flaky"), F.col("key").cast("bigint").alias("line"), F.lit(0).alias("column"))
    sure = lambda o: F.count_if((F.col("outcome") == o) & ~F.col("flaky")).alias(o)
    entries = mutants.groupBy("unit").agg(F.lit("h1").alias("hash"), F.count("*").alias("sites"), *map(sure, ("killed", "survived", "uncovered")))
    functions = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit"), F.when(F.col("o_custkey") % 4 > 0, "h1").otherwise("h2").alias("hash"))
    sites = line.where("l_discount > 0.03").select("unit", "key", (1000 + F.col("l_partkey")).alias("line"), F.lit(0).alias("column"))
    counted, kept = mutation.on_sites(entries, mutants, functions, sites)
    lines = kept.groupBy("unit").agg(F.count("*").alias("mutants"), F.sum("line").alias("lines"))
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("mutants", "lines")}
    return counted.drop("hash").join(lines, "unit", "left").withColumns(zero)


@query(f"WITH m AS (SELECT user_id AS unit, {OUTCOME} AS o FROM events) SELECT unit, count(*) FILTER (o IN ('killed', 'timeout', 'over-limit')) AS killed, count(*) FILTER (o = 'survived') AS survived, count(*) FILTER (o = 'uncovered') AS uncovered, count(*) FILTER (o <> 'skipped') AS sites FROM m GROUP BY unit")
def q_snapshot_tallies(spark, d):
    return history.tallies(table(spark, d, "events").select(F.col("user_id").alias("unit"), F.expr(OUTCOME).alias("outcome")))


@query("SELECT event_id, sha256('seed-1' || chr(0) || CAST(event_id AS VARCHAR) || chr(0) || event_type) AS rank FROM events ORDER BY rank, event_id LIMIT 20")
def q_sample_rank(spark, d):
    return history.draw(table(spark, d, "events").select("event_id", "event_type"), "seed-1", ["event_id", "event_type"], 20).select("event_id", "rank")


TRIALS = """tr AS (SELECT user_id AS id, 'killed' AS recorded, event_id AS ord, CASE WHEN value > 20 THEN 'survived' WHEN value > 10 THEN 'timeout' ELSE 'killed' END AS outcome FROM events)"""


def _trials(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("id"), F.lit("killed").alias("recorded"), F.col("event_id").alias("ord"), F.when(F.col("value") > 20, "survived").when(F.col("value") > 10, "timeout").otherwise("killed").alias("outcome"))


@query(f"""WITH {TRIALS}, l AS (SELECT id, recorded, list(outcome ORDER BY ord) AS o FROM tr GROUP BY ALL) SELECT id, recorded, CAST(len(o) AS BIGINT) AS trials, CASE WHEN o[1] <> 'survived' THEN 'agreed' WHEN len(list_filter(o, lambda x: x <> 'survived')) > 0 THEN 'flaky' WHEN len(o) <= 2 THEN 'pending' ELSE 'mismatched' END AS verdict FROM l""")
def q_trial_verdicts(spark, d):
    return history.trial_verdicts(_trials(spark, d))


@query(f"WITH {TRIALS}, l AS (SELECT id, count(DISTINCT CASE WHEN outcome = 'survived' THEN 's' ELSE 'n' END) AS k, count(*) AS n FROM tr GROUP BY id) SELECT id, CASE WHEN k > 1 THEN 'flaky' WHEN n <= 2 THEN 'pending' ELSE 'agreed' END AS state FROM l")
def q_settled(spark, d):
    return history.settled(_trials(spark, d))


@query("SELECT o_orderkey, round(o_totalprice * 2.0::DOUBLE + 5, 4) AS limit_seconds, CAST(trunc(o_orderkey * 1.5::DOUBLE) AS BIGINT) + 16777216 AS limit_output, CASE WHEN o_orderstatus = 'F' THEN CAST(trunc(o_custkey * 3.0::DOUBLE) AS BIGINT) + 268435456 END AS limit_memory FROM orders")
def q_limits(spark, d):
    x = table(spark, d, "orders")
    of = scores.limits(F.col("o_totalprice"), F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus") == "F", (2.0, 1.5, 3.0))
    return x.select("o_orderkey", F.round(of["limit_seconds"], 4).alias("limit_seconds"), of["limit_output"].alias("limit_output"), of["limit_memory"].alias("limit_memory"))


# --- selection and text --------------------------------------------------------------------------------


@query("SELECT url AS path, CASE WHEN contains(url, '/en/') THEN '/en/' WHEN contains(url, 'ref=') THEN 'ref=' ELSE '#top' END AS fragment FROM pages WHERE contains(url, '/en/') OR contains(url, 'ref=') OR contains(url, '#top')")
def q_select(spark, d):
    return selection.select_fragments(table(spark, d, "pages").select(F.col("url").alias("path")), ["/en/", "ref=", "#top"]).select("path", "fragment")


@query(r"WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', '') AS path FROM pages) SELECT page_id, path, regexp_matches(path, '^([^/]+/)*(en|de)/[^/]*5[^/]*$') OR regexp_matches(path, '^[^/]*\.net(/.*)?$') AS excluded FROM p")
def q_exclude(spark, d):
    path = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^[a-z]+://", "")
    return selection.exclude(table(spark, d, "pages").select("page_id", path.alias("path")), ["**/{en,de}/*5*", "*.net/**"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def q_json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_windows(spark, d):
    return live.windowed_counts(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("WITH b AS (SELECT l_orderkey AS file, CAST(l_linenumber AS VARCHAR) AS span, l_quantity AS weight, l_discount > 0.05 AS covered FROM lineitem) SELECT file, span, max(weight) AS weight, bool_or(covered) AS covered FROM b GROUP BY ALL")
def q_span_union(spark, d):
    return coverage.span_union(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("string").alias("span"), F.col("l_quantity").alias("weight"), (F.col("l_discount") > 0.05).alias("covered")))


@query(f'WITH {SEGMENTS} SELECT file, CAST(line AS INT) AS line, bool_or(covered > 0) AS covered FROM (SELECT file, covered, unnest(range(start, "end" + 1)) AS line FROM segments) GROUP BY ALL')
def q_line_inventory(spark, d):
    return coverage.line_inventory(_segments(spark, d))


@query(f"""WITH {SEGMENTS}, i AS (SELECT * FROM segments WHERE from_mask = 2), p AS (SELECT DISTINCT file, is_branch, key FROM segments WHERE from_mask = 1 AND ran)
  SELECT file, is_branch, key, start, ran FROM i WHERE file NOT IN (SELECT file FROM p) OR key = '' OR EXISTS (SELECT 1 FROM p WHERE p.file = i.file AND p.is_branch = i.is_branch AND p.key = i.key)""")
def q_restrict_integration(spark, d):
    x = _segments(spark, d)
    return coverage.restrict_integration(x.where("from_mask = 2"), x.where("from_mask = 1 AND ran")).select("file", "is_branch", "key", "start", "ran")


# --- order of candidates, duplicates of functions, module nodes, draws -------------------------------------


def _duplicates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders and parts of line items as pairs of functions, scored by quantity; parts and orders as functions in files."""
    pairs = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"), (F.col("l_quantity").cast("double") / 64).alias("score")).groupBy("a", "b").agg(F.max("score").alias("score"))
    ids = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("id")).union(table(spark, d, "part").select(F.col("p_partkey") * 2 + 1))
    return pairs, ids.select("id", F.concat(F.lit("f"), F.col("id") % 37).alias("file"), F.col("id").alias("start_line"))


DUPLICATES = """u AS (SELECT id, 'f' || (id % 37) AS file FROM (SELECT o_orderkey * 2 AS id FROM orders UNION ALL SELECT p_partkey * 2 + 1 FROM part)),
  p AS (SELECT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b, max(CAST(l_quantity AS DOUBLE) / 64) AS score FROM lineitem GROUP BY ALL),
  c AS (SELECT floor(score * 1000 + 0.5) / 1000 AS score, x.file AS xf, a, y.file AS yf, b, (x.file, a) < (y.file, b) AS first FROM p JOIN u x ON a = x.id JOIN u y ON b = y.id),
  found AS (SELECT score, CASE WHEN first THEN xf ELSE yf END AS left_file, CASE WHEN first THEN a ELSE b END AS left_line, CASE WHEN first THEN yf ELSE xf END AS right_file, CASE WHEN first THEN b ELSE a END AS right_line FROM c)"""


@query(f"WITH {DUPLICATES} SELECT * FROM found ORDER BY score DESC, left_file, left_line, right_file, right_line")
def q_dry_order(spark, d):
    return similarity.candidates(*_duplicates(spark, d))


@query(f"WITH {DUPLICATES}, n AS (SELECT file, line, count(*) AS n FROM (SELECT left_file AS file, left_line AS line FROM found UNION ALL SELECT right_file, right_line FROM found) GROUP BY ALL) SELECT u.file, id AS start_line, coalesce(n, 0) AS duplicates FROM u LEFT JOIN n ON u.file = n.file AND id = line")
def q_duplicate_counts(spark, d):
    pairs, units = _duplicates(spark, d)
    return similarity.duplicate_counts(units.drop("id"), similarity.candidates(pairs, units))


def _modules(spark: SparkSession, d: str) -> DataFrame:
    """Parts as modules of the repository shop, in folders of their types and brands, and shop itself."""
    name = F.concat(F.lit("shop/"), F.concat_ws("/", "p_type", "p_brand"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("/"), F.col("p_partkey"))).otherwise(""))
    modules = table(spark, d, "part").select(name.alias("id")).distinct().select("id", F.lit("module").alias("kind"), F.substring_index("id", "/", -1).alias("label"))
    return modules.union(spark.range(1).select(F.lit("shop"), F.lit("repo"), F.lit("shop")))


MODULES = """m AS (SELECT DISTINCT 'shop/' || p_type || '/' || p_brand || CASE WHEN p_partkey % 5 > 0 THEN '/' || p_partkey ELSE '' END AS id FROM part),
  dirs AS (SELECT DISTINCT 'shop/' || p_type AS id FROM part UNION SELECT 'shop/' || p_type || '/' || p_brand FROM part WHERE p_partkey % 5 > 0),
  nodes AS (SELECT id, 'module' AS kind FROM m UNION ALL SELECT id, 'dir' FROM dirs WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT 'shop', 'repo')"""


@query(f"WITH {MODULES} SELECT id, kind, regexp_replace(id, '^.*/', '') AS label, CASE WHEN kind = 'repo' THEN '' ELSE regexp_replace(id, '/[^/]*$', '') END AS parent FROM nodes")
def q_attach_children(spark, d):
    return graph.children(graph.attach(_modules(spark, d), "shop"))


@query(f"WITH {MODULES} SELECT 1 AS repositories, (SELECT count(*) FROM m) AS modules, (SELECT count(*) FROM part) AS functions, (SELECT count(*) FROM lineitem) AS edges".replace("SELECT 1 AS", "SELECT CAST(1 AS BIGINT) AS"))
def q_graph_totals(spark, d):
    return graph.totals(graph.attach(_modules(spark, d), "shop"), table(spark, d, "part"), table(spark, d, "lineitem"))


MODULE_OF = "'shop/' || p_type || '/' || p_brand || CASE WHEN p_partkey % 5 > 0 THEN '/' || p_partkey ELSE '' END"


def _module_of() -> Column:
    return F.concat(F.concat_ws("/", "p_type", "p_brand"), F.when(F.col("p_partkey") % 5 > 0, F.concat(F.lit("/"), F.col("p_partkey"))).otherwise(""))


@query(f"""WITH {MODULES}, f AS (SELECT {MODULE_OF} AS id, 'files' AS field, 'f' || (p_partkey % 7) AS value FROM part UNION ALL
      SELECT {MODULE_OF}, CASE l_linenumber % 3 WHEN 0 THEN 'serves' WHEN 1 THEN 'calls' ELSE 'external' END, 's' || (l_suppkey % 9) FROM lineitem JOIN part ON l_partkey = p_partkey),
  g AS (SELECT id, {", ".join(f"coalesce(string_agg(DISTINCT value, ',' ORDER BY value) FILTER (field = '{x}'), '') AS {x}" for x in graph.FIELDS)} FROM f GROUP BY id)
  SELECT id, kind, CASE WHEN kind <> 'repo' THEN regexp_replace(id, '/[^/]*$', '') END AS parent, {", ".join(f"coalesce({x}, '') AS {x}" for x in graph.FIELDS)} FROM nodes LEFT JOIN g USING (id)""")
def q_module_nodes(spark, d):
    part = table(spark, d, "part").select("p_partkey", _module_of().alias("module"))
    field = F.when(F.col("l_linenumber") % 3 == 0, "serves").when(F.col("l_linenumber") % 3 == 1, "calls").otherwise("external")
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("module", field.alias("field"), F.concat(F.lit("s"), F.col("l_suppkey") % 9).alias("value"))
    facts = part.select("module", F.lit("files").alias("field"), F.concat(F.lit("f"), F.col("p_partkey") % 7).alias("value")).union(lines)
    return graph.module_nodes(facts, "shop").select("id", "kind", "parent", *(F.array_join(x, ",").alias(x) for x in graph.FIELDS))


@query(f"""WITH RECURSIVE {MODULES}, kids AS (SELECT regexp_replace(id, '/[^/]*$', '') AS up, count(*) AS n, min(id) AS child FROM nodes GROUP BY ALL),
  boxes AS (SELECT CASE WHEN kind = 'dir' AND n = 1 THEN child ELSE id END AS box FROM nodes LEFT JOIN kids ON up = id WHERE regexp_replace(id, '/[^/]*$', '') = 'shop/PROMO'),
  place AS (SELECT id, box FROM nodes JOIN boxes ON id = box OR starts_with(id, box || '/')), mod AS (SELECT p_partkey, {MODULE_OF} AS id FROM part),
  e AS (SELECT a.box AS from_box, b.box AS to_box, CASE WHEN x.l_suppkey % 5 = 0 THEN 'http' ELSE 'import' END AS kind, x.l_linenumber AS n, CASE WHEN x.l_suppkey % 5 = 0 THEN x.l_returnflag END AS via
    FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 JOIN mod s ON s.p_partkey = x.l_partkey JOIN mod t ON t.p_partkey = y.l_partkey LEFT JOIN place a ON a.id = s.id LEFT JOIN place b ON b.id = t.id),
  arrows AS (SELECT from_box, to_box, kind, CAST(sum(n) AS BIGINT) AS count, count(*) AS pairs, coalesce(string_agg(DISTINCT via, ',' ORDER BY via), '') AS via FROM e WHERE from_box <> to_box GROUP BY ALL),
  r AS (SELECT from_box AS a, to_box AS b FROM arrows WHERE kind = 'import' UNION SELECT r.a, to_box FROM r JOIN arrows ON kind = 'import' AND from_box = r.b),
  sides AS (SELECT box, (SELECT sum(n) FROM e WHERE to_box = box AND from_box IS NULL) AS incoming, (SELECT sum(n) FROM e WHERE from_box = box AND to_box IS NULL) AS outgoing FROM boxes)
  SELECT *, kind = 'import' AND EXISTS (SELECT 1 FROM r WHERE r.a = to_box AND r.b = from_box) AS cycle FROM arrows UNION ALL SELECT box, NULL, 'outside', CAST(coalesce(incoming, 0) AS BIGINT), CAST(coalesce(outgoing, 0) AS BIGINT), '', false FROM sides""")
def q_view_level(spark, d):
    """One level of the tree of modules, lines after each other in an order as edges: arrows, and for each box what comes from and goes outside."""
    nodes = graph.attach(_modules(spark, d), "shop")
    part = table(spark, d, "part").select("p_partkey", F.concat(F.lit("shop/"), _module_of()).alias("id"))
    lines = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    following = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("id").alias("dst"))
    web = F.col("l_suppkey") % 5 == 0
    edges = lines.join(following, ["l_orderkey", "l_linenumber"]).select(F.col("id").alias("src"), "dst", F.when(web, "http").otherwise("import").alias("kind"), F.col("l_linenumber").cast("bigint").alias("count"), F.when(web, F.array("l_returnflag")).alias("via"))
    boxes = cut(graph.level(nodes, nodes.select(F.col("id").alias("node")), "shop/PROMO"))
    arrows, sides = graph.view(edges, cut(graph.boxed(nodes, boxes)))
    rows = graph.mark_cycles(cut(arrows)).select("from_box", "to_box", "kind", "count", "pairs", F.array_join("via", ",").alias("via"), "cycle")
    return rows.union(sides.select("box", F.lit(None).cast("string"), F.lit("outside"), "incoming", "outgoing", F.lit(""), F.lit(False)))


@query("""WITH r AS (SELECT 'src/' || o_custkey AS path, CAST(o_orderkey AS VARCHAR) AS identity, sha256('fresh-plan-v2' || chr(0) || '7' || chr(0) || 'src/' || o_custkey || chr(0) || o_orderkey) AS rank FROM orders)
  SELECT path, identity, rank, row_number() OVER (ORDER BY rank, identity) <= 50 AS selected FROM r""")
def q_fresh_plan(spark, d):
    sites = table(spark, d, "orders").select(F.concat(F.lit("src/"), F.col("o_custkey")).alias("path"), F.col("o_orderkey").cast("string").alias("identity"))
    return history.fresh_plan(sites, "7", 50).select("path", "identity", "rank", "selected")
