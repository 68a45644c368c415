"""Token-ID files with fixed-width bit packing.

A shard holds the ids of documents in ascending id order, each id in the fewest bits that hold every
id of the vocabulary, least significant bit first.  Layout, little-endian:

    "TOKB", version u16, bits u16, ids of a block u32            header
    blocks of ids, each padded to whole bytes
    block offsets u64 x (blocks + 1), document ids i64, null marks u8, document starts u64 x (documents + 1)
    documents u64, ids u64, blocks u64, place of the block offsets u64, "TOKB"

Block offsets and document starts give random access; a block is unpacked at once by numpy.  Documents
are dealt to shards by ranges of their id, so shard order is document order, and are encoded after
that, so only texts are shuffled and each is encoded once.  A shard is written under a name of its
own for each attempt; the manifest names the shards of the attempts that count.

Edge cases: a null or empty text has the end id alone; null ids come first; of repeated ids the order
within is not defined; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm import tokens
from llm.common import file_system, shared_folder, whole, written

MAGIC, VERSION = b"TOKB", 1
HEADER, TRAILER = struct.Struct("<4sHHI"), struct.Struct("<QQQQ4s")
BLOCK_IDS = 1 << 16
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
MANIFEST = "part bigint, file string, n_docs bigint, n_ids bigint"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = ((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(spread, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, "<u4")
    for i in range(bits):
        out |= spread[:, i].astype("<u4") << np.uint32(i)
    return out


class ShardWriter:
    """Writes a shard to a binary stream, holding one block of ids."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held, self.offsets, self.at = bytearray(), [HEADER.size], HEADER.size
        self.docs: list[int | None] = []
        self.starts = [0]
        out.write(HEADER.pack(MAGIC, VERSION, bits, block_ids))

    def _flush(self, size: int) -> None:
        data = pack(np.frombuffer(bytes(self.held[:size]), "<u4"), self.bits)
        del self.held[:size]
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def add(self, doc: int | None, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        self.docs.append(doc)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.held += ids
        while len(self.held) >= 4 * self.block_ids:
            self._flush(4 * self.block_ids)

    def close(self) -> None:
        if self.held:
            self._flush(len(self.held))
        for part in (np.array(self.offsets, "<u8"), np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs], np.uint8), np.array(self.starts, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(len(self.docs), self.starts[-1], len(self.offsets) - 1, self.at, MAGIC))


class ShardReader:
    """Reads a shard from a binary file that can seek."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2) if not hasattr(file, "size") else file.size()
        magic, version, self.bits, self.block_ids = HEADER.unpack(self._at(0, HEADER.size))
        n, self.n_ids, blocks, at, end = TRAILER.unpack(self._at(size - TRAILER.size, TRAILER.size))
        if magic != MAGIC or end != MAGIC or version != VERSION:
            raise ValueError("not a whole token-id shard")
        index = self._at(at, size - TRAILER.size - at)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1)
        ids = np.frombuffer(index, "<i8", n, 8 * (blocks + 1))
        null = np.frombuffer(index, np.uint8, n, 8 * (blocks + 1 + n))
        self.docs = [None if x else int(i) for i, x in zip(ids, null)]
        self.starts = np.frombuffer(index, "<u8", n + 1, 8 * (blocks + 1 + n) + n)
        self._held = (-1, np.zeros(0, "<u4"))

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(int(at))
        return self.file.read(int(size))

    def block(self, i: int) -> np.ndarray:
        if self._held[0] != i:
            n = min(self.block_ids, self.n_ids - i * self.block_ids)
            self._held = (i, unpack(self._at(self.offsets[i], self.offsets[i + 1] - self.offsets[i]), n, self.bits))
        return self._held[1]

    def runs(self, start: int, end: int):
        """The ids of places start to end, in pieces of a block at most."""
        while start < end:
            i, skip = divmod(start, self.block_ids)
            part = self.block(i)[skip : skip + end - start]
            yield part
            start += len(part)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, "<u4"), *self.runs(start, end)])


def write_shards(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents' ids as shards below folder; the manifest (part, file, n_docs, n_ids), parts in document order."""
    top = max(tokens.load(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
    bits, end = top.bit_length(), b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, writer, file = TaskContext.get().partitionId(), None, f"{folder}/shard-{uuid.uuid4().hex}.ids"
        for batch in batches:
            if batch.num_rows and writer is None:
                fs, path = file_system(file)
                fs.create_dir(path.rpartition("/")[0])
                out = fs.open_output_stream(path, compression=None)
                writer = ShardWriter(out, bits)
            for doc, ids in zip(batch["doc_id"].to_pylist(), tokens.encoder(tokenizer).encode(t.as_py() for t in batch["text"])):
                writer.add(doc, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "n_docs": len(writer.docs), "n_ids": writer.starts[-1]}])

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), whole(text_col).alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    return written(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, MANIFEST), "ids-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the shards."""
    shards = manifest.count()
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard in batch.to_pylist():
                fs, path = file_system(shard["file"])
                with fs.open_input_file(path) as file:
                    reader = ShardReader(file)
                    sums = []
                    for a, b in zip(reader.starts[:-1], reader.starts[1:]):
                        crc = 0
                        for part in reader.runs(int(a), int(b)):
                            crc = zlib.crc32(part.tobytes(), crc)
                        sums.append(crc)
                starts = reader.starts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(reader.docs, pa.int64()), pa.array(starts[:-1] + shard["before"]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("file", "before").repartition(max(1, shards)).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """read_documents of write_shards; folder: by default a new one below the shared folder."""
    return read_documents(write_shards(docs, folder or shared_folder(docs.sparkSession, "token-ids"), **options))
