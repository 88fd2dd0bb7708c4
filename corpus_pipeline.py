"""From documents to packed training sequences, a stage per operator.

Stages take ``(spark, docs, sf_dir)``.  Every stage but the last returns the columns of
``documents``; its result is written as Parquet and read again as the next one's input.  Nulls,
empty tables and repeated rows are treated as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.llm import mixing, near_copies, packing, repetition, secrets
from flowsieve.llm.common import stored_table
from flowsieve.llm.queries import PACKING, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates by SimHash or shingles, the one with the smallest id."""
    return near_copies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as taken, the one at the end of a source's budget in part."""
    return mixing.mixed_copies(docs)


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes: ``sequence_id`` and ``offset``."""
    name, boundary, end_id = PACKING
    return packing.pack(docs, vocabulary(spark, name, boundary), end_id=end_id)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("packing", packed_pieces),
]

# Fingerprints, tokenizers and compressors are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
