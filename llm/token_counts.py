"""Token counts with a digest cache.

The cache is a Parquet folder of (digest of content, digest of the tokenizer's files and version,
n_tokens).  Contents that it lacks are encoded once each, wherever and however often they occur, and
appended.  Content is normalised by `normalise`, which has to leave counts as they are; the default
only takes null for empty.

Contents that occur once are encoded where they are read.  Those that occur more often are brought
together by their digest after map-side aggregation, so a text that a third of all rows share is sent
once a task.  A cache may hold a digest more than once (writers that append side by side, repeated
appends): counts of a digest are aggregated when they are read.

Edge cases: null and empty texts have no bytes and no tokens; repeated rows count alike; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import tokens
from llm.common import BROADCAST_BYTES, shared_folder, small_side, trim, whole, written

TOKENIZER = "word_bpe_49k.json"
CACHE = "digest binary, tokenizer string, n_tokens bigint"


def _by_misses(texts: DataFrame, wanted: DataFrame, known: DataFrame) -> DataFrame:
    """texts whose digest the cache lacks: by what is missing or by what is known, whichever is less."""
    n, most = wanted.count(), known.count()
    if n <= most:
        return texts.join(small_side(wanted.select("digest"), 64), "digest", "left_semi")
    return texts.join(small_side(known.select("digest"), 64), "digest", "left_anti")


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's entries; none if the folder isn't there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache)


def _counter(tokenizer: str, version: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts = pa.array(tokens.encoder(tokenizer, True).encode(batch["text"].to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array([version] * batch.num_rows, pa.string()), counts], names=["digest", "tokenizer", "n_tokens"])
        trim()

    return run


def fill_cache(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, text_col: str = "text", normalise=whole, digests: DataFrame | None = None) -> None:
    """Appends the counts of all contents of docs that the cache lacks."""
    version = tokens.version_digest(tokenizer)
    texts = docs.select(normalise(text_col).alias("text")).select(F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    known = cached(docs.sparkSession, cache).where(F.col("tokenizer") == version)
    cold = known.limit(1).count() == 0
    wanted = (texts if digests is None else digests).groupBy("digest").agg(F.count("*").alias("n"))
    wanted = written(wanted if cold else wanted.join(known, "digest", "left_anti"), "counts-wanted")
    if not cold:
        texts = _by_misses(texts, wanted, known)
    repeated = wanted.where("n > 1").select("digest")
    if repeated.count() * 64 <= BROADCAST_BYTES:
        again = texts.join(F.broadcast(repeated), "digest", "left_semi").dropDuplicates(["digest"])
        texts = texts.join(F.broadcast(repeated), "digest", "left_anti").unionByName(again)
    else:
        texts = texts.dropDuplicates(["digest"])
    texts.mapInArrow(_counter(tokenizer, version), CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = 2048, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", normalise=whole) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.  cache: the folder to use and extend; by default a new one."""
    cache = cache or shared_folder(docs.sparkSession, "counts-cache")
    text = normalise(text_col)
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(whole(text_col)).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest")), "counts-rows")
    fill_cache(docs, cache, tokenizer, text_col, normalise, rows.select("digest"))
    counts = cached(docs.sparkSession, cache).where(F.col("tokenizer") == tokens.version_digest(tokenizer)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
