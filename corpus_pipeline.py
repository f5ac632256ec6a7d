"""The corpus pipeline: its stages in order, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontamination, langid, packing, passages, simhash
from geoloom.session import stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by nearest centroid; those that it rejects go, null texts and texts without letters too.

    Repeated rows stay or go together; whole texts are read; ties go to the first centroid; an empty table stays empty; all
    columns stay as they are.
    """
    return langid.keep_identified(docs, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere already; n_chars follows them."""
    return passages.drop_repeated_passages(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars")).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids, a digest in place of each piece's ids."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("bigint").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("harmonic_packing", pack),
]
#: Fingerprint components, MinHash bands and byte-pair ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: Rows of an Arrow batch while the stages run: whole texts in batches of Spark's 10,000 fill memory beside the heap.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "2000"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`; each result is a stored table that the next stage reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_ROWS)
    try:
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
    finally:
        spark.conf.set(BATCH, before)
    return STAGES[-1][1](spark, docs, sf_dir)
