"""Committed JSON snapshots: explicit schemas, reading and atomic writing."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
CRAP = "version int, entries array<struct<namespace:string,name:string,language:string,file:string,start_line:int,end_line:int,complexity:int,coverage:double,crap:double>>"
_SIDE = "struct<file:string,start_line:int,end_line:int,namespace:string,name:string,nodes:int>"
DRY = f"version int, threshold double, candidates array<struct<score:double,language:string,left:{_SIDE},right:{_SIDE}>>, groups array<struct<language:string,min_score:double,max_score:double,members:array<{_SIDE}>>>"
_EVIDENCE = "struct<tests:map<string,string>,support:map<string,string>>"
MUTANTS = (
    "version int, file string, language string, tests map<string,string>, listed map<string,string>, support map<string,string>, units array<struct<namespace:string,name:string,hash:string,start_line:int,end_line:int,"
    f"killed:int,survived:int,uncovered:int,sites:int,stale:boolean,mutants:array<struct<line:int,column:int,offset:int,original:string,replacement:string,outcome:string,limit:string,scope:string,tests:array<string>,suite_evidence:{_EVIDENCE},go_evidence:{_EVIDENCE},flaky:boolean,outcomes:array<string>>>>>"
)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A snapshot with its schema, never inferred; None if there is none; unreadable files fail."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)


def mutants(snapshot: DataFrame) -> DataFrame:
    """(file, namespace, name, hash, mutant columns): one row a recorded mutant; older names of evidence still count."""
    rows = snapshot.select("file", F.explode("units").alias("u")).select("file", "u.namespace", "u.name", "u.hash", F.coalesce("u.stale", F.lit(False)).alias("stale"), F.explode("u.mutants").alias("m"))
    return rows.select("file", "namespace", "name", "hash", "stale", "m.line", "m.column", "m.offset", "m.original", "m.replacement", "m.outcome", F.coalesce("m.suite_evidence", "m.go_evidence").alias("evidence"))


def same_map(a, b):
    """Whether two maps are equal; null equals nothing, and an empty map an empty map."""
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def write_snapshot(rows: DataFrame, path: str, name: str) -> None:
    """A small, bounded result as one indented JSON file, moved into place at once; an empty one has an empty list."""
    entries = [json.loads(r) for r in rows.toJSON().collect()]
    columns = rows.columns
    data = json.dumps({"version": VERSION, name: [{c: e.get(c) for c in columns} for e in entries]}, indent=2) + "\n"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "w") as f:
        f.write(data)
    os.replace(temporary, path)


def remove(path: str, root: str) -> None:
    """A snapshot goes, and with it the folders below root that it leaves empty."""
    os.unlink(path)
    folder = os.path.dirname(path)
    while os.path.abspath(folder) != os.path.abspath(root) and not os.listdir(folder):
        os.rmdir(folder)
        folder = os.path.dirname(folder)


def envelope(result: DataFrame, problems: DataFrame) -> dict:
    """What a command prints: its rows, its findings and whether it found none.  For reports, which are bounded."""
    found = [json.loads(p) for p in problems.toJSON().collect()]
    return {"schema": 1, "ok": not found, "result": [json.loads(r) for r in result.toJSON().collect()], "problems": found}
