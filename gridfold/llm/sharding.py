"""Weighted rendezvous sharding of records by a stable key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridfold.session import stage


def rendezvous_score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u): the shard with the largest score takes the record, so
    each shard gets its share of weight, and a record moves only to a shard
    that is new or whose weight grew. u is in (0, 1), from 53 hash bits."""
    u = (F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(-float(weight)) / F.log(u)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Shard of the largest score; equal scores go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    scores = [F.struct(rendezvous_score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["i"]


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per row of ``docs``.

    The law is ``key``: doc_id and the weighted shard list alone decide, and
    ``grown_shard`` (one shard more, of ``grown_weight``) differs from ``shard``
    only where the new shard takes the row.

    ``slot`` numbers the rows of a shard from 0 without gaps. The digest rows
    are written once; rows are then ranked within (shard, input partition) and
    shifted by the running count of the earlier partitions, so no task ever
    holds more of a shard than one input partition does, however many rows
    share a key.

    A null text has size 1 and the checksum of no bytes; null keys are one key;
    repeated rows get the same shard and slots of their own; an empty table
    gives an empty result; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    best = rendezvous_shard(F.col("doc_id"), weights)
    grown = rendezvous_shard(F.col("doc_id"), [*weights, grown_weight])
    digest = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        best.cast("int").alias("shard"),
        grown.cast("int").alias("grown_shard"),
        F.monotonically_increasing_id().alias("at"),
    )
    digest = stage(docs.sparkSession, digest, "shard-digest").withColumn("part", F.shiftrightunsigned("at", 33))
    counts = digest.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("at")) - 1
    return (
        digest.withColumn("rank", rank).join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )
