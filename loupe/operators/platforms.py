"""Which Go files a platform builds: by the name's suffix and by the build constraint above the package clause.

A constraint is judged once for each (constraint, platform) that occurs, however many files have it.  Tags that a platform decides
(systems, architectures, unix) are fixed; all others may be given to a build or not, so a file is left out only if no setting
of them builds it here and some setting builds it somewhere.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Systems, the Unix ones among them, architectures, and systems on which another one's tag holds too.
SYSTEMS = ("aix", "android", "darwin", "dragonfly", "freebsd", "hurd", "illumos", "ios", "js", "linux", "nacl", "netbsd", "openbsd", "plan9", "solaris", "wasip1", "windows", "zos")
UNIX = ("aix", "android", "darwin", "dragonfly", "freebsd", "hurd", "illumos", "ios", "linux", "netbsd", "openbsd", "solaris")
ARCHITECTURES = (
    "386", "amd64", "amd64p32", "arm", "armbe", "arm64", "arm64be", "loong64", "mips", "mipsle", "mips64", "mips64le", "mips64p32", "mips64p32le", "ppc", "ppc64", "ppc64le", "riscv", "riscv64", "s390", "s390x",
    "sparc", "sparc64", "wasm",
)
ALSO = {"android": "linux", "illumos": "solaris", "ios": "darwin"}
#: A constraint that leaves more tags open is taken as built (fixed value).
OPEN_TAGS = 12

_TOKEN = re.compile(r"\s*(&&|\|\||[!()]|[\w.]+)")
_TAG = re.compile(r"[\w.]+")


def _infix(text: str) -> list[str] | None:
    """The tokens of an expression in postfix order; None if it isn't one.  Operators wait on a list: ! before &&, && before ||."""
    out, waiting, at, value = [], [], 0, False
    order = {"||": 0, "&&": 1, "!": 2}
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        token, at = m[1], m.end()
        if token in ("(", "!") or token not in (")", "&&", "||"):
            if value or (token == "!" and waiting[-1:] == ["!"]):  # a value is due only once, and !! is no expression
                return None
            if token in ("(", "!"):
                waiting.append(token)
                continue
            out.append(token)
            value = True
            continue
        if not value:
            return None
        while waiting and waiting[-1] != "(" and (token == ")" or order[waiting[-1]] >= order[token]):
            out.append(waiting.pop())
        if token == ")":
            if not waiting:
                return None
            waiting.pop()
        else:
            waiting.append(token)
            value = False
    if not value or "(" in waiting:
        return None
    return out + waiting[::-1]


def _plus(text: str) -> list[str]:
    """A +build line in postfix order: words are alternatives, commas join; what is no tag counts as the tag ignore."""
    out: list[str] = []
    for i, word in enumerate(text.split()):
        for j, term in enumerate(word.split(",")):
            tag = term.removeprefix("!")
            good = _TAG.fullmatch(tag) is not None
            out += [tag if good else "ignore"] + (["!"] if term.startswith("!") and not term.startswith("!!") and term != "!" else []) + (["&&"] if j else [])
        out += ["||"] if i else []
    return out or ["ignore"]


def header(text: str) -> list[str]:
    """The comment lines above the package clause that count: those before the last blank line."""
    lines, end, block = [], 0, False
    for line in text.split("\n"):
        line = line.strip()
        if block:
            _, closed, after = line.partition("*/")
            block = not closed
            if closed and after.strip():
                break
        elif not line:
            end = len(lines)
        elif line.startswith("/*"):
            block = "*/" not in line[2:]
        elif not line.startswith("//"):
            break
        lines.append(line)
    return lines[:end]


def postfix(text: str) -> str | None:
    """A file's constraint in postfix order, blanks between; None if it has none, or one that doesn't parse."""
    plus: list[str] = []
    for line in header(text):
        if m := re.match(r"//go:build\s+(.*)", line):
            found = _infix(m[1])
            return None if found is None else " ".join(found)
        if m := re.fullmatch(r"//\s*\+build(?:\s+(.*))?", line):
            plus += _plus(m[1] or "") + (["&&"] if plus else [])
    return " ".join(plus) or None


def _holds(tag: str, system: str, architecture: str) -> bool | None:
    """Whether the platform gives a tag; None if that isn't the platform's to say."""
    if tag in SYSTEMS:
        return tag == system or ALSO.get(system) == tag
    if tag == "unix":
        return system in UNIX
    return tag == architecture if tag in ARCHITECTURES else None


def satisfiable(expression: str, platform: tuple[str, str] | None) -> bool:
    """Whether some setting of the tags that the platform leaves open makes it true; all settings are taken at once, as arrays.  None leaves all open."""
    tokens = expression.split(" ")
    fixed = {t: None if platform is None else _holds(t, *platform) for t in tokens if t not in ("!", "&&", "||")}
    free = [t for t, v in fixed.items() if v is None]
    if len(free) > OPEN_TAGS:
        return True
    settings = np.arange(1 << len(free))
    held = {t: np.full(len(settings), v) for t, v in fixed.items() if v is not None} | {t: (settings >> i & 1).astype(bool) for i, t in enumerate(free)}
    stack: list[np.ndarray] = []
    for token in tokens:
        if token == "!":
            stack.append(~stack.pop())
        elif token in ("&&", "||"):
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if token == "&&" else a | b)
        else:
            stack.append(held[token])
    return bool(stack[0].any())


def name_suffix(path: Column) -> tuple[Column, Column]:
    """(system, architecture) that a file's name ends in, each null if it doesn't: before the first dot and any _test, after the first underscore."""
    stem = F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("."), F.lit(1))
    parts = F.filter(F.split(stem, "_"), lambda _, i: i > 0)
    parts = F.when(F.element_at(F.concat(F.array(F.lit("")), parts), -1) == "test", F.slice(F.concat(F.array(F.lit("")), parts), 1, F.size(parts))).otherwise(F.concat(F.array(F.lit("")), parts))
    last, before = F.element_at(parts, -1), F.element_at(F.concat(F.array(F.lit("")), parts), -2)
    system = F.when(before.isin(*SYSTEMS) & last.isin(*ARCHITECTURES), before).when(last.isin(*SYSTEMS), last)
    return system, F.when(last.isin(*ARCHITECTURES), last)


def constraints(files: DataFrame) -> DataFrame:
    """files (file, text) with constraint, in postfix order; NULL without one that parses."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [postfix(t) if t else None for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(found, pa.string())], names=[*batch.schema.names, "constraint"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{schema}, constraint string")


def built_on(files: DataFrame) -> DataFrame:
    """files (file, text, system, architecture) with constraint and built, whether their platform builds them.  A null platform, as of files in no Go folder, builds all."""
    rows = constraints(files)
    judged = rows.where("constraint IS NOT NULL AND system IS NOT NULL AND architecture IS NOT NULL").select("constraint", "system", "architecture").distinct()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [not satisfiable(c, (s, a)) and satisfiable(c, None) for c, s, a in zip(*(batch[n].to_pylist() for n in ("constraint", "system", "architecture")))]
            yield pa.RecordBatch.from_arrays([batch["constraint"], batch["system"], batch["architecture"], pa.array(out, pa.bool_())], names=["constraint", "system", "architecture", "out"])

    ruled = judged.mapInArrow(run, "constraint string, system string, architecture string, out boolean")
    system, architecture = name_suffix(F.col("file"))
    also = F.create_map(*(F.lit(x) for pair in ALSO.items() for x in pair))[F.col("system")]
    named = (system.isNotNull() & (system != F.col("system")) & ~F.coalesce(also == system, F.lit(False))) | (architecture.isNotNull() & (architecture != F.col("architecture")))
    out = F.coalesce(named, F.lit(False)) | F.coalesce("out", F.lit(False))
    return rows.join(ruled, ["constraint", "system", "architecture"], "left").select(*files.columns, "constraint", (~out).alias("built"))
