"""From raw documents to packed training sequences: language ID, exact dedup, near dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, language, mixing, near_dedup, packing
from textloom.llm.common import remove, scratch, shared_dir


# Every stage takes any table with the columns of documents: null and empty texts, repeated rows, ties, very long texts and
# empty tables as the operator that it calls says; more columns, of any name, come through.


#: Chunks that a packing worker keeps and characters that it encodes at once: the executors hold what the stages before took.
PACK_CACHE = 120_000
PACK_ENCODED = 1 << 19


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters (so null and empty texts go), or none with a score above one half."""
    return language.keep_identified(docs, language.fit(docs.where(~language.held_out())))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the fullest row of each group of texts that differ in white space only; null and blank texts are one group."""
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies; documents without words or doc_id stay."""
    return near_dedup.keep_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks, up to twice, dealt to shards and shuffled in each."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 4096; a null text is the end id alone."""
    return packing.packed(docs, cache=PACK_CACHE, encoded=PACK_ENCODED)


STAGES = [("language", identify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Learned languages, hashed draws and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables go when its result is written, and a result when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
