"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridfold.llm.centroids import centroid_sql
from gridfold.llm.common import table
from gridfold.llm.embed_dedup import link_sql


def op1_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.embed_dedup import dedup_vectors

    return dedup_vectors(table(spark, sf_dir, "embeddings"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.fingerprints import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.simhash_dedup import dedup_documents

    return dedup_documents(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.secret_scan import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.line_dedup import dedup_lines

    lines = dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfold.llm.token_files import token_file_documents

    return token_file_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_embedding_graph, op2_fingerprints, op3_byte_bpe, op4_simhash_dedup, op5_token_counts, op6_secret_scan,
    op7_line_dedup, op8_best_fit_packing, op9_quality, op10_rendezvous_shards,
    op11_centroid_clusters, op12_token_alignment, op13_token_files,
)}
ORACLES: dict[str, str] = {"op1_embedding_graph": link_sql(), "op11_centroid_clusters": centroid_sql()}
