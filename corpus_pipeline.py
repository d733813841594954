"""From raw documents to packed sequences: STAGES in order, each on all that the last one kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``docs``.  Rows without an id, repeated rows, empty tables and further columns are
treated as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flawsieve.llm import exact_dedup, jaccard_join, packing, quality_rules, secret_scan
from flawsieve.llm.common import documents, staged

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go; documents that fail or lost too much go."""
    return quality_rules.clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays."""
    return exact_dedup.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays."""
    return jaccard_join.one_of_each_class(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a placeholder; all documents stay."""
    return secret_scan.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a packed sequence."""
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [("quality rules", quality), ("exact dedup", exact_copies),
          ("n-gram Jaccard join", near_copies), ("secret scans", secrets),
          ("packing", sequences)]
# Tokenising and bin packing are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
