"""Corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of the one before;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridfold.llm.common import table
from gridfold.llm.line_dedup import dedup_line_documents
from gridfold.llm.packing import pack_documents
from gridfold.llm.quality import keep_documents
from gridfold.llm.secret_scan import redact_documents
from gridfold.llm.simhash_dedup import keep_one
from gridfold.session import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; every document stays."""
    return dedup_line_documents(docs, threshold=0.8)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of 3 words, links at 3 bits."""
    return keep_one(docs, words=3, max_distance=3)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed into sequences of at most 1,024 tokens."""
    return pack_documents(docs, max_tokens=1024)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: the classifier, XXH64 and the tokenizer can't be written in it.
#: tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        docs = stage(spark, stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
