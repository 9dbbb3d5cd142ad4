"""From raw documents to packed training sequences in five stages, each on all that the one before kept.

All stages but the last keep the columns of documents; n_chars follows the text where a stage changes it. An empty table
stays empty. How nulls, empty and repeated rows fare is said in the operators' own modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecmine.llm import bagminhash, language, packing, pii, recompression
from vecmine.llm.queries import bpe_files
from vecmine.session import scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus has; those that the centroids reject go."""
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return bagminhash.one_of_each(docs)


def remove_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out."""
    return recompression.remove(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs, pii.fit_field(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs, **bpe_files())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", remove_substrings),
    ("pii", redact_pii),
    ("packing", pack),
]
# Loopy messages, clustering and signatures have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
