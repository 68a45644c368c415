"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match has to
hold.  Texts are indexed in blocks: postings (block, trigram -> the texts that hold it) of the trigrams
that the queries ask for, in lower case.  A rule's query intersects and unites postings; only texts it
leaves are searched with the expression itself, whole.  Rules without a necessary trigram, such as runs
of hex digits, search every text.  A block is indexed, asked and verified where it was read, so no text
is shuffled; `postings` returns the index as a table instead.

Spans are in code points, end exclusive; leftmost and non-overlapping within a rule.

Edge cases: null and empty texts have no spans; repeated rows have the same ones; other columns aren't
read; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose group `group` has `shortest` characters at least.

    search: a narrower expression with the same hits, for searching; by default the pattern.
    """

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0
    ignore_case: bool = False
    search: str | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.search or self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base kinds in their order (fixed values).  A run that is long enough is what the shorter pattern would match there.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, search=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, search=r"[0-9a-f]{24,}"),
)
#: Further kinds, after the base ones: key blocks and tokens of well-known forms.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", ignore_case=True),
)

#: A query: True (any text), or ("and" | "or", parts), or a trigram of lower-case bytes.
Query = bool | bytes | tuple[str, frozenset]
#: Exact strings held for an expression, and characters of a class taken one by one.
MOST_STRINGS, MOST_CHARS = 24, 6


def _join(kind: str, parts: list[Query]) -> Query:
    parts = set(parts)
    if kind == "and":
        parts.discard(True)
        if not parts:
            return True
    elif True in parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else (kind, frozenset(parts))


def _of_strings(strings: set[str]) -> Query:
    """Any of the strings: all trigrams of one of them."""
    def one(s: str) -> Query:
        data = s.encode()
        return _join("and", [data[i : i + 3] for i in range(len(data) - 2)])

    return _join("or", [one(s) for s in strings]) if strings else True


def _lower(code: int) -> str:
    return chr(code).lower() if code < 128 else chr(code)


def _walk(items) -> tuple[set[str] | None, Query]:
    """(all strings that the items can match, lower-cased, or None if they are many or unbounded; what a match has to hold besides)."""
    strings, needs = {""}, []
    for op, arg in items:
        own, need = _item(op, arg)
        needs.append(need)
        if strings is not None and own is not None and len(strings) * len(own) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
            continue
        if strings is not None:
            needs.append(_of_strings(strings))
        strings = own if own is not None else {""}
        needs.append(None)  # the strings no longer cover the items from their start
    if None in needs:
        return None, _join("and", [n for n in needs if n is not None] + [_of_strings(strings)])
    return strings, _join("and", needs)


def _item(op, arg) -> tuple[set[str] | None, Query]:
    if op is sre.LITERAL:
        return {_lower(arg)}, True
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(_lower(value))
            elif kind is sre.RANGE and value[1] - value[0] < MOST_CHARS:
                chars |= {_lower(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= MOST_CHARS else (None, True)
    if op is sre.SUBPATTERN:
        return _walk(arg[3])
    if op is sre.BRANCH:
        found = [_walk(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and len(all_ := set().union(*(s for s, _ in found))) <= MOST_STRINGS:
            return all_, _join("or", [n for _, n in found])
        return None, _join("or", [_join("and", [n, _of_strings(s)]) if s is not None else n for s, n in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        least, most, what = arg
        own, need = _walk(what)
        if own is not None and (least, most) in ((0, 1), (1, 1)):
            return own | ({""} if not least else set()), True if not least else need
        if not least:
            return None, True
        return None, _join("and", [need, _of_strings(own)]) if own is not None else need
    if op in (sre.AT, sre.ASSERT_NOT):
        return {""}, True
    return None, True


@functools.lru_cache(64)
def trigram_query(pattern: str) -> Query:
    """What every match of the expression has to hold, in lower-case UTF-8 trigrams; True if nothing is known."""
    strings, need = _walk(parser.parse(pattern))
    return _join("and", [need, _of_strings(strings)]) if strings is not None else need


def trigrams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set() if query is True else set().union(*map(trigrams, query[1]))


def ask(query: Query, postings: Callable[[bytes], np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Sorted numbers of the texts that the query leaves; the shortest postings are intersected first."""
    if query is True:
        return everything
    if isinstance(query, bytes):
        return postings(query)
    found = sorted((ask(q, postings, everything) for q in query[1]), key=len)
    join = functools.partial(np.intersect1d, assume_unique=True) if query[0] == "and" else np.union1d
    return functools.reduce(join, found)


class Index:
    """The postings of wanted trigrams in a block of texts."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = {t: i for i, t in enumerate(wanted)}
        self.number = np.full(1 << 24, -1, np.int16 if len(wanted) < 1 << 15 else np.int32)
        for t, i in self.wanted.items():
            self.number[int.from_bytes(t, "big")] = i
        self.lists: list[np.ndarray] = []

    def build(self, texts: list[bytes], slice_bytes: int = 1 << 22) -> None:
        """Texts are lower-cased bytes."""
        data = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = []
        for a in range(0, len(data) - 2, slice_bytes):
            part = data[a : a + slice_bytes + 2].astype(np.uint32)
            numbers = self.number[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(numbers >= 0)
            pairs.append(np.unique(numbers[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at + a, "right")))
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        edges = np.searchsorted(found, np.arange(len(self.wanted) + 1) * len(texts))
        self.lists = [found[a:b] - i * len(texts) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]

    def __call__(self, trigram: bytes) -> np.ndarray:
        return self.lists[self.wanted[trigram]]


@functools.lru_cache(4)
def _prepared(rules: tuple[Rule, ...]) -> tuple[list[tuple[Rule, re.Pattern, Query]], Index]:
    ready = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
    return ready, Index(sorted(set().union(*(trigrams(q) for _, _, q in ready))))


#: Bytes of a block.
BLOCK_BYTES = 8 << 20


def _blocks(texts: list[str | None]):
    block, size = [], 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(texts: list[str | None], rules: tuple[Rule, ...] = BASE + MORE) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end) in order."""
    ready, index = _prepared(rules)
    out: list[list[tuple[int, int, int]]] = []
    for block in _blocks(texts):
        index.build([t.encode().lower() for t in block])
        everything, spans = np.arange(len(block)), [[] for _ in block]
        for number, (rule, pattern, query) in enumerate(ready):
            for i in map(int, ask(query, index, everything)):
                spans[i] += [(m.start(), number, m.end()) for m in pattern.finditer(block[i]) if m.end(rule.group) - m.start(rule.group) >= rule.shortest]
        out += [sorted(s) for s in spans]
    return out


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of the base kinds, and all spans, of every row."""
    bounded_batches(docs.sparkSession)
    rules = BASE + tuple(more)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for spans in find(batch["text"].to_pylist(), rules):
                base = ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if k < len(BASE))
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(len(BASE))), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)))
            columns = list(zip(*rows)) or [()] * (len(BASE) + 2)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in columns[: len(BASE)]), *(pa.array(c, pa.string()) for c in columns[len(BASE) :])], names=names)

    names = ["doc_id", *(f"n_{r.kind}" for r in BASE), "base_sha256", "spans"]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, {', '.join(f'n_{r.kind} bigint' for r in BASE)}, base_sha256 string, spans string")


def postings(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table: (trigram, ids) for each block and trigram that the rules ask for."""

    def run(batches):
        import pyarrow as pa

        index = _prepared(rules)[1]
        for batch in batches:
            ids, at = np.array(batch["doc_id"].to_pylist(), object), 0
            for block in _blocks(batch["text"].to_pylist()):
                index.build([t.encode().lower() for t in block])
                held = [(t, ids[at + index(t)].tolist()) for t in index.wanted if len(index(t))]
                at += len(block)
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.binary()), pa.array([i for _, i in held], pa.list_(pa.int64()))], names=["trigram", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "trigram binary, ids array<bigint>")
