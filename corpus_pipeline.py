"""A corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and works on all
documents its predecessor kept. Between two stages the documents are written as Parquet to the
shared folder and read again, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopledger.llm import bpe, jaccard, mixing, pii, quality
from shopledger.plans.pinning import pin


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays.

    Five-word shingles, Jaccard similarity of 0.8 or more.
    """
    return jaccard.representatives(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by labels, disclosing terms by their class or nothing."""
    return pii.sanitised_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut down or repeated to their target weights."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encoded_documents(docs, keep=["doc_id", "lang", "source", "n_chars"])


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Vocabulary lookups and corpus statistics of the stages have no SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = pin(stage(spark, docs, sf_dir), f"stage_{i}")
    return docs
