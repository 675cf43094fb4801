"""Corpus pipeline: five stages, each over all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet and read again.  All but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import exact, packing, quality, secret_scan, simhash
from chronolith.llm.common import cut
from chronolith.llm.queries import WORD_BPE, WORD_END, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the latest policy go."""
    return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.keep(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts give way to a mark."""
    return secret_scan.redact(docs)


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs, vocabulary(WORD_BPE), WORD_END)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_redaction),
    ("packing", curve_packing),
]

#: Python hashes, tokenizes and compresses in several stages; SQL has no such functions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
