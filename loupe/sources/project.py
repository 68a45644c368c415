"""What a project says about its files: build outputs, generated code, git, settings, tsconfig."""

from __future__ import annotations

import json
import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupe.functions.paths import ancestors

#: Folders that may be build outputs, manifests that make them so, suffixes of generated Dart (fixed values).
OUTPUTS = ("target", "build", "dist", "out", "coverage")
MANIFESTS = ("package.json", "pom.xml", "build.gradle", "build.gradle.kts", "Cargo.toml", "pubspec.yaml", "pyproject.toml", "setup.py", "CMakeLists.txt", "Makefile", "go.mod")
GENERATED = (".g.dart", ".freezed.dart", ".mocks.dart", ".gr.dart", ".config.dart")


def without_build_outputs(files: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """files (path) less those below an output folder that a manifest stands beside, or that is ignored (dir)."""
    steps = files.select("path", F.explode(ancestors(F.col("path"))).alias("dir")).where(F.element_at(F.split("dir", "/"), -1).isin(*OUTPUTS)).where("dir <> path")
    above = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")
    beside = files.where(F.element_at(F.split("path", "/"), -1).isin(*MANIFESTS)).select(above(F.col("path")).alias("parent")).distinct()
    gone = steps.withColumn("parent", above(F.col("dir"))).join(beside, "parent", "left_semi").select("path")
    if ignored is not None:
        gone = gone.union(steps.join(ignored.select("dir"), "dir", "left_semi").select("path"))
    return files.join(gone.distinct(), "path", "left_anti")


def without_generated_dart(files: DataFrame) -> DataFrame:
    """files (path, content) less generated Dart: by suffix, or by a first line that says so."""
    head = F.substring(F.decode("content", "utf-8"), 1, 200)
    by_name = F.lit(False)
    for suffix in GENERATED:
        by_name = by_name | F.col("path").endswith(suffix)
    return files.where(~(F.col("path").endswith(".dart") & (by_name | head.rlike(r"(?i)^\s*//.*(generated code|do not modify by hand)"))))


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def changed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): added, modified and renamed files against HEAD, and untracked ones, that exist."""
    names = set(_git(root, "diff", "--name-only", "--diff-filter=AMR", "-z", "HEAD").split("\0")) | set(_git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0"))
    return spark.createDataFrame([(n,) for n in sorted(names) if n and os.path.exists(os.path.join(root, n))], "path string")


def diff_since(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(report, text): the diff since the merge base with ref, without context and with renames, for sources.reports.read_diff."""
    return spark.createDataFrame([(0, _git(root, "diff", "-U0", "-M", f"{ref}...HEAD"))], "report int, text string")


def removed_since(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(path, renamed_to): files that are gone since ref; NULL if they were deleted."""
    rows = []
    for line in _git(root, "diff", "--name-status", "-M", "--diff-filter=DR", f"{ref}...HEAD").splitlines():
        status, *names = line.split("\t")
        rows.append((names[0], names[1] if status.startswith("R") else None))
    return spark.createDataFrame(rows, "path string, renamed_to string")


def hashes(files: DataFrame) -> DataFrame:
    """(file, hash): SHA-256 of each file (path, content)."""
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("hash"))


def repository_name(url, folder):
    """The last part of a remote's URL without .git; the folder's name without a remote."""
    return F.coalesce(F.expr("nullif(regexp_extract(url, '([^/:]+?)(?:\\\\.git)?/?$', 1), '')") if isinstance(url, str) else F.nullif(F.regexp_extract(url, r"([^/:]+?)(?:\.git)?/?$", 1), F.lit("")), folder)


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; what strings hold stays."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out, flags=re.DOTALL)


def tsconfig_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """(prefix, alias, rank) from the paths of a tsconfig and what it extends, targets relative to folder; the base folder last."""
    rows: list[tuple[str, str, int]] = []

    def read(path: str, seen: frozenset[str]) -> dict:
        if path in seen or not os.path.exists(path):
            return {}
        with open(path) as f:
            own = json.loads(strip_jsonc(f.read()))
        options = dict(own.get("compilerOptions", {}))
        options.setdefault("_dir", os.path.dirname(path))
        if "extends" in own:
            parent = os.path.join(os.path.dirname(path), own["extends"])
            up = read(parent if parent.endswith(".json") else parent + ".json", seen | {path})
            if not {"paths", "baseUrl"} & options.keys():
                options |= {k: up[k] for k in ("paths", "baseUrl", "_dir") if k in up}
        for reference in own.get("references", []):
            where = os.path.join(os.path.dirname(path), reference["path"])
            other = read(where if where.endswith(".json") else os.path.join(where, "tsconfig.json"), seen | {path})
            options.setdefault("paths", other.get("paths", {}))
        return options

    options = read(os.path.join(folder, "tsconfig.json"), frozenset())
    base = os.path.relpath(os.path.join(options.get("_dir", folder), options.get("baseUrl", ".")), folder)
    join = lambda x: os.path.normpath(os.path.join(base, x)).removeprefix("./")
    for prefix, targets in options.get("paths", {}).items():
        rows += [(prefix.removesuffix("*"), (join(t.removesuffix("*")) + "/") if t.endswith("/*") else join(t), i) for i, t in enumerate(targets)]
    if "baseUrl" in options:
        rows.append(("", "" if base == "." else base + "/", 0))
    return spark.createDataFrame(rows, "prefix string, alias string, rank int")


def timed_out_packages(logs: DataFrame) -> DataFrame:
    """(package) of Go test logs (report, text) that end in a timeout: the failed package after each panic line."""
    from pyspark.sql import Window

    rows = logs.select("report", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("report").orderBy("pos")
    mark = F.when(F.col("line").startswith("panic: test timed out"), True).when(F.col("line").rlike(r"^(ok|FAIL|---)\s"), F.lit(False))
    before = rows.withColumn("timed", F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return before.where("timed AND line LIKE 'FAIL\t%'").select(F.split("line", "\t")[1].alias("package")).distinct()
