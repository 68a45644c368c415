"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents, with all rows that it keeps:

1. language_id: texts without letters go, and those that the classifier finds no likelier in any learned
   language than among n-grams drawn alike (random letters, unknown scripts).
2. exact_dedup: of texts equal after lower-casing A-Z, the row with the largest doc_id stays.
3. near_dedup: of documents linked by SimHash fingerprints (3 bits) or by a Jaccard similarity of 0.8 or
   more of five-word shingles, the one with the smallest doc_id stays.
4. decontaminate: documents that hold a benchmark window go.
5. pack: what is left is packed into sequences.

Rows with null or empty text go in the first stage.  An empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontamination, exact_dedup, language_id, packing, simhash
from llm.common import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs, ~language_id.held_out()))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, similarity=simhash.SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]

#: Fingerprint components and packing have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
