"""WARC archives with deduplicated payloads and a merged capture index.

Writing: payload digests are grouped with map-side aggregation, so of equal payloads one capture keeps
the payload and the others are revisits of it.  Each task writes gzipped archives, a member for each
record, and a capture run: the entries of what it wrote, sorted by URL key, timestamp and page.

External merge: the runs are cut at global boundaries (quantiles of the whole key, page included, so
that a URL with a third of all captures is cut like any other) and each range's segments are merged by
a loser tree, MOST_RUNS at a time; more segments are merged in rounds.  Ranges in order are the
capture histories in global order.

Reading goes by the merged index: each archive's entries are read at their offsets.

Archives are written under names of their own for each attempt; the runs name those that count.

Edge cases: a null html is an empty payload; an empty table gives no archives and no rows; of rows with
equal page ids and payloads all are responses if that page is; null ids rank after all others as a
response; null urls have an empty key; ids may be any bigint, negative ones too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import file_system, shared_folder, small_side, written

#: Bytes of an archive after which the next one begins, and entries of one merged range.
ARCHIVE_BYTES, RANGE_ENTRIES = 256 << 20, 50_000
#: Runs that one loser tree merges, and entries of a run held together before it is handed on.
MOST_RUNS, RUN_ENTRIES = 64, 50_000
#: Captures without a time of their own are taken to have been made one second a page from here, starting again after so many seconds; so any bigint id gives a year of four digits.
EPOCH, CYCLE = datetime(2020, 1, 1, tzinfo=UTC), 366 * 86_400
ENTRY = "urlkey string, ts string, page_id bigint, digest string, record_type string, file string, at bigint, length bigint"
KEY = ["urlkey", "ts", "page_id", "file", "at"]


def url_key(url: Column) -> Column:
    """The sort key of a URL: host labels reversed and comma-joined, then `)` and the path with query, in lower case; no scheme, `www.`, default port or fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^[^@]*@|^www\d*\.|:(80|443)$", "")
    path = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def record_bytes(kind: str, page_id: int | None, url: str, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A gzipped WARC/1.1 record; a revisit holds no payload but its digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Payload-Length: {len(payload)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """The record of a gzip member: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, payload.

    A response's digest and length are taken from its payload and have to agree with its head.
    """
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    payload, kind, said = block.partition(b"\r\n\r\n")[2], fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: int(x) if x else None
    if kind == "response":
        size, digest, refers = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None
        if digest != said:
            raise ValueError("a payload doesn't have its digest")
    else:
        size, digest, refers = int(fields["WARC-Payload-Length"]), said, number(re.match(r"<urn:page:(-?\d*)", fields["WARC-Refers-To"])[1])
    return {"page_id": number(fields["WARC-Page-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers, "url": fields["WARC-Target-URI"], "date": fields["WARC-Date"], "payload": payload}


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of matches, so the next winner takes log2(k) comparisons."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.nodes = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.nodes[node] = (a, b) if self._wins(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), item)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def __iter__(self):
        while self.heads[self.top] is not None:
            yield self.heads[self.top][1]
            i = self.top
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._wins(self.nodes[node], i):
                    i, self.nodes[node] = self.nodes[node], i
                node //= 2
            self.top = i


def merge(runs: list[list], key, most: int = MOST_RUNS) -> list:
    """All items of the sorted runs in order, by rounds of loser trees over `most` runs."""
    while len(runs) > 1:
        runs = [list(LoserTree(runs[i : i + most], key)) for i in range(0, len(runs), most)]
    return runs[0] if runs else []


def _order(e: dict):
    return e["urlkey"], e["ts"], e["page_id"] is not None, e["page_id"] or 0, e["file"], e["at"]


def _writer(folder: str, archive_bytes: int):
    """Writes a task's rows as archives and yields their capture runs, each sorted."""

    def run(batches):
        import pyarrow as pa

        fs, top = file_system(folder)
        out, name, at, entries, batch_run = None, "", 0, [], 0

        def sealed(entries):
            entries.sort(key=_order)
            mark = uuid.uuid4().hex
            for i in range(0, len(entries), 10_000):
                yield pa.RecordBatch.from_pylist([e | {"run": mark} for e in entries[i : i + 10_000]], schema=schema)

        kinds = {"string": pa.string(), "bigint": pa.int64()}
        schema = pa.schema([pa.field(c.split()[0], kinds[c.split()[1]]) for c in ENTRY.split(", ")] + [pa.field("run", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = f"capture-{uuid.uuid4().hex}.warc.gz", 0
                    fs.create_dir(top)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                payload = (r["html"] or "").encode()
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                member = record_bytes(r["kind"], r["page_id"], r["url"] or "", r["ts"], payload, digest, r["refers_to"])
                out.write(member)
                entries.append({"urlkey": r["urlkey"], "ts": r["ts"], "page_id": r["page_id"], "digest": digest, "record_type": r["kind"], "file": f"{folder}/{name}", "at": at, "length": len(member)})
                at += len(member)
                if len(entries) >= RUN_ENTRIES:
                    yield from sealed(entries)
                    entries = []
        if out is not None:
            out.close()
        yield from sealed(entries)

    return run


def write_archives(pages: DataFrame, folder: str, shortest: int = 0, archive_bytes: int = ARCHIVE_BYTES, time_col: str | None = None) -> DataFrame:
    """Writes a record for each page below folder; the capture runs (entries with their run), written.

    Of equal payloads of at least `shortest` bytes, the capture with the smallest page_id is the response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    when = F.col(time_col) if time_col else F.timestamp_seconds(F.lit(int(EPOCH.timestamp())) + F.pmod(F.coalesce(F.col("page_id").cast("bigint"), F.lit(0)), F.lit(CYCLE)))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(html).alias("sha"), F.octet_length(html).alias("size"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    # the smallest page of each payload, null ids last
    first = rows.where(F.col("size") >= shortest).groupBy("sha").agg(F.min(F.struct(F.col("page_id").isNull().alias("late"), "page_id")).alias("first"), F.count("*").alias("n"))
    shared = written(first.where("n > 1").select("sha", F.col("first.page_id").alias("first_id"), F.lit(True).alias("shared")), "warc-shared")
    joined = rows.join(small_side(shared, 80), "sha", "left")
    own = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(own, F.lit("response")).otherwise(F.lit("revisit"))
    ready = joined.select("page_id", "url", "html", "sha", "ts", url_key(F.col("url")).alias("urlkey"), kind.alias("kind"), F.when(~own, F.col("first_id")).alias("refers_to"))
    return written(ready.mapInArrow(_writer(folder, archive_bytes), f"{ENTRY}, run string"), "warc-runs")


def merged_index(runs: DataFrame) -> DataFrame:
    """(range, place, entry): the entries of all runs in global order of URL key, timestamp and page.

    Boundaries are exact quantiles of entries bucketed by Spark's range partitioner; each range merges its segments.
    """
    n = max(1, -(-runs.count() // RANGE_ENTRIES))
    n = max(n, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionByRange(n, F.col("urlkey"), F.col("ts"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("at"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        segments: dict[str, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for e in batch.to_pylist():
                segments.setdefault(e["run"], []).append(e)
        part, place = TaskContext.get().partitionId(), 0
        for s in segments.values():  # a run's blocks may arrive in another order than they were sent
            if any(_order(a) > _order(b) for a, b in zip(s, s[1:])):
                s.sort(key=_order)
        entries = merge(list(segments.values()), _order)
        for i in range(0, len(entries), 10_000):
            block = entries[i : i + 10_000]
            columns = [pa.array([e[f.name] for e in block], f.type) for f in schema if f.name != "run"]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(block), pa.int64()), pa.array(range(place, place + len(block)), pa.int64()), *columns], names=["range", "place", *(f.name for f in schema if f.name != "run")])
            place += len(block)

    return written(dealt.mapInArrow(run, f"range bigint, place bigint, {ENTRY}"), "warc-index")


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record that the index names, read at its place: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload)."""

    def run(batches):
        held, name = None, None
        try:
            for batch in batches:
                rows = []
                for e in batch.to_pylist():
                    if e["file"] != name:
                        if held is not None:
                            held.close()
                        fs, path = file_system(e["file"])
                        held, name = fs.open_input_file(path), e["file"]
                    held.seek(e["at"])
                    rows.append(parse_record(held.read(e["length"])))
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)
        finally:
            if held is not None:
                held.close()

    import pyarrow as pa

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    schema = pa.schema(list(kinds.items()))
    ddl = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if payloads else "")
    entries = index.select("file", "at", "length")
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE_ENTRIES))
    return entries.repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at").mapInArrow(run, ddl)


def round_trip(pages: DataFrame, folder: str | None = None, shortest: int = 0, **options) -> DataFrame:
    """Writes the pages, merges the capture runs and reads every record back."""
    runs = write_archives(pages, folder or shared_folder(pages.sparkSession, "warc"), shortest, **options)
    return read_archives(merged_index(runs))
