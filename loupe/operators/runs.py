"""Which command runs the tests of a source, and which tests it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.operators import graph
from loupe.operators.mutation import BROAD

#: Commands by language, tool, whether all tests are asked for, and where the tests that reach the source lie (none, one folder, many, or
#: other, which is a module besides the source's own); None stands for any.  Words in braces are filled in.
RULES = [
    ("go", None, True, None, "go test -count=1 -failfast ./..."),
    ("go", None, False, None, "go test -count=1 -failfast {package}"),
    ("typescript", "vitest", True, None, "{bin} run --bail=1"),
    ("typescript", "vitest", False, None, "{bin} related --run --bail=1 {path}"),
    ("typescript", "jest", True, None, "{bin} --bail"),
    ("typescript", "jest", False, None, "{bin} --bail --findRelatedTests {path}"),
    ("typescript", "npm", None, None, "npm run test --silent"),
    ("typescript", None, None, None, "{bin} run test"),
    ("python", "pytest", True, None, "{bin} -m pytest -q -x -p no:cacheprovider"),
    ("python", "pytest", False, "one", "{bin} -m pytest -q -x -p no:cacheprovider {names}"),
    ("python", "pytest", False, "many", "{bin} -m pytest -q -x -p no:cacheprovider {names}"),
    ("python", "unittest", True, None, "{bin} -m unittest discover -f"),
    ("python", "unittest", False, "one", "{bin} -m unittest -f {modules}"),
    ("python", "unittest", False, "many", "{bin} -m unittest -f {modules}"),
    ("dart", "flutter", True, None, "{bin} test --no-pub"),
    ("dart", "flutter", False, "one", "{bin} test --no-pub {names}"),
    ("dart", "flutter", False, "many", "{bin} test --no-pub {names}"),
    ("kotlin", "gradle", True, None, "{bin} test --fail-fast"),
    ("kotlin", "gradle", False, "one", "{bin} -p {folder} test --fail-fast {classes}"),
    ("kotlin", "gradle", False, "many", "{bin} {tasks}"),
    ("kotlin", "mvn", True, None, "mvn -q test"),
    ("kotlin", "mvn", False, "one", "mvn -q test {surefire}"),
    ("kotlin", "mvn", False, "other", "mvn -q test -pl {modules_of} -am {surefire}"),
]
READY, ALL_TESTS = "pub get --offline", BROAD[0]
NEVER_ON_HOST = ("integration_test", "test_driver")


def rules(spark) -> DataFrame:
    """The decision table: language, and its rules with their number, the most specific first."""
    rows = [(i, *r, sum(x is not None for x in r[1:4])) for i, r in enumerate(RULES)]
    table = spark.createDataFrame(rows, "rule int, language string, tool string, whole boolean, spread string, words string, fixed int")
    order = F.array_sort(F.collect_list(F.struct((-F.col("fixed")).alias("rank"), "rule", "tool", "whole", "spread", F.split("words", " ").alias("words"))))
    return table.groupBy("language").agg(order.alias("rules"))


def relative(base: Column, path: Column) -> Column:
    """path from base, `.` for base itself; NULL if it doesn't lie there.  An empty base holds every path."""
    return F.when(path == base, ".").when(base == "", path).when(F.startswith(path, F.concat(base, F.lit("/"))), F.substr(path, F.length(base) + 2))


def _each(word: str, items: Column) -> Column:
    return F.flatten(F.transform(items, lambda x: F.array(F.lit(word), x)))


def choose(requests: DataFrame, tests: DataFrame) -> DataFrame:
    """requests with rule, args, folder, suite, ready and path_dirs: the narrowest command that runs a source's tests.

    requests: id, language, tool, bin (array), root (for Maven that of all modules), module (the source's, for Maven), path, whole, shell.  tests: id, folder, name,
    and module, the tests that reach a request's source: files for Python and Dart, qualified classes for Kotlin; those whose folder
    isn't root or below it don't count.  args is NULL where nothing is to be run, and where a shell command stands for it; suite says that
    a command runs more than was asked for.  Rules of a language come as one array, so requests meet them by a broadcast of the
    decision table, and of those that fit the most specific one counts.
    """
    inside = tests.join(requests.select("id", "root", F.col("module").alias("own")), "id").withColumn("rel", relative(F.col("root"), F.col("folder"))).where("rel IS NOT NULL")
    by_folder = inside.groupBy("id", "folder", "rel", "own").agg(F.array_sort(F.collect_set("name")).alias("names"), F.array_sort(F.collect_set("module")).alias("modules"))
    task = F.concat(F.lit(":"), F.when(F.col("rel") == ".", "test").otherwise(F.concat(F.replace("rel", F.lit("/"), F.lit(":")), F.lit(":test"))))
    found = by_folder.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("folder", "rel", "names", task.alias("task"), (F.col("folder") == F.col("own")).alias("mine")))).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("modules")))).alias("modules"),
    )
    rows = requests.join(found, "id", "left").join(F.broadcast(rules(requests.sparkSession)), "language", "left")
    n = F.coalesce(F.size("at"), F.lit(0))
    spread = F.when(F.coalesce(n, F.lit(0)) <= 0, "none").when(F.col("tool") == "mvn", F.when(F.exists("at", lambda x: ~x["mine"]), "other").otherwise("one")).when(n == 1, "one").otherwise("many")
    fits = lambda r: (r["tool"].isNull() | r["tool"].eqNullSafe(F.col("tool"))) & (r["whole"].isNull() | (r["whole"] == F.col("whole"))) & (r["spread"].isNull() | (r["spread"] == F.col("spread")))
    rows = rows.withColumn("spread", spread).withColumn("hit", F.get(F.filter("rules", fits), F.lit(0)))
    mine, others = F.filter("at", lambda x: x["mine"]), F.filter("at", lambda x: ~x["mine"])
    rel = lambda xs: F.transform(xs, lambda x: x["rel"])
    up = relative(F.col("root"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    package = F.when((up == ".") | (up == ""), "./.").otherwise(F.concat(F.lit("./"), up))
    fill = {
        "{bin}": F.col("bin"), "{package}": F.array(package), "{path}": F.array(relative(F.col("root"), F.col("path"))), "{names}": F.col("names"), "{modules}": F.col("modules"), "{folder}": rel(F.col("at")),
        "{classes}": _each("--tests", F.col("names")), "{tasks}": F.flatten(F.transform("at", lambda x: F.concat(F.array(x["task"], F.lit("--fail-fast")), _each("--tests", x["names"])))),
        "{modules_of}": F.array(F.array_join(F.concat(rel(mine), rel(others)), ",")), "{surefire}": F.array(F.concat(F.lit("-Dtest="), F.array_join("names", ",")), F.lit("-Dsurefire.failIfNoSpecifiedTests=false")),
    }

    def filled(word: Column) -> Column:
        out = F.array(word)
        for name, value in fill.items():
            out = F.when(word == name, F.coalesce(value, F.array().cast("array<string>"))).otherwise(out)
        return out

    shell = F.coalesce(F.col("shell"), F.lit("")) != ""
    args = F.when(~shell, F.flatten(F.transform(F.col("hit.words"), filled)))
    mvn = (F.col("language") == "kotlin") & (F.col("tool") == "mvn")
    where = F.when(mvn & (F.col("whole") | (F.col("spread") != "other")), F.col("module")).otherwise(F.col("root"))
    ready = F.when((F.col("language") == "dart") & ~shell & (F.size("bin") > 0), F.concat("bin", F.split(F.lit(READY), " ")))
    suite = (F.col("language") == "typescript") & ~F.coalesce(F.col("tool").isin("vitest", "jest"), F.lit(False))
    dirs = F.when(F.col("language") == "python", F.array(F.lit("."), F.lit("src")))
    return rows.select(*(F.col(c) for c in requests.columns), F.when(~shell, F.col("hit.rule")).alias("rule"), args.alias("args"), where.alias("folder"), suite.alias("suite"), ready.alias("ready"), dirs.alias("path_dirs"))


def _packages(sources: DataFrame, markers: DataFrame) -> DataFrame:
    """sources (path, language) with package: the nearest folder above that markers (marker) name, else the file's own; (root) is the top, here the empty path."""
    own = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    folders = sources.select(F.when(own == "", "(root)").otherwise(own).alias("path")).distinct()
    near = graph.nearest_prefix(folders, markers).select(F.col("path").alias("own"), F.coalesce("marker", "path").alias("package"))
    found = sources.withColumn("own", F.when(own == "", "(root)").otherwise(own)).join(near, "own", "left").drop("own")
    return found.withColumn("package", F.when(F.col("package") == "(root)", "").otherwise(F.col("package")))


def eligible(reaching: DataFrame, sources: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, test) of reaching that a source's own run really runs or rests on.

    For Dart those are runnable tests below the package's test folder and support files that aren't for a device; without any such runnable test
    none.  For other languages all.  sources: path, language; reaching: path, test; markers: folders of package files.
    """
    rows = reaching.join(_packages(sources.select("path", "language").distinct(), markers), "path").withColumn("rel", relative(F.col("package"), F.col("test")))
    in_tests, runnable = F.coalesce(F.startswith("rel", F.lit("test/")), F.lit(False)), F.col("test").endswith("_test.dart")
    parts = F.split(F.coalesce("rel", "test"), "/")
    device = F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*NEVER_ON_HOST))
    judged = rows.withColumn("runs", in_tests & runnable).withColumn("kept", F.when(runnable, in_tests).otherwise(in_tests | ~device))
    runs = judged.where("runs").select("path").distinct().withColumn("any", F.lit(True))
    return judged.join(runs, "path", "left").where("language <> 'dart' OR (kept AND any)").select("path", "test")


def suite(sources: DataFrame, tests: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, test, hash): the whole suite that an outcome of a source rests on: tests (root, test, hash) of its build root, and for Dart under the scope of all tests only those in its package's test folder.

    sources: path, language, root, scope.
    """
    rows = _packages(sources, markers).join(tests, "root").withColumn("rel", relative(F.col("package"), F.col("test")))
    narrow = (F.col("language") == "dart") & (F.col("scope") == ALL_TESTS)
    return rows.where(~narrow | F.coalesce(F.startswith("rel", F.lit("test/")), F.lit(False))).select("path", "test", "hash")
