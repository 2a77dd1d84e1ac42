"""The corpus pipeline: `documents` through the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; between stages the rows are written as Parquet to the shared folder and read again,
so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, packing, quality, sanitise, simhash
from tessera.llm.common import documents, table_of


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the production policy."""
    return quality.keep_passing(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component: 3-word shingles, at most 2 bits apart."""
    return simhash.keep_one(docs, shingle=3, radius=2)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced in their texts."""
    return sanitise.sanitised(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", pii),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

# SQL has no XXH64, so it can't say which documents the second stage keeps
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table_of(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
