"""Which file wins each batch, and batch replacement.

A run may carry several files per batch_key. Applied one at a time in
landing order, the last *valid* file of a batch replaces it whole, and a
valid file with no surviving rows still empties it. So the winner is chosen
on the file list, not on the rows, and the replaced keys are the batch keys
of all valid files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def winning_files(files: DataFrame, valid: Column | None = None) -> DataFrame:
    """Adds ``is_winner``: the file that wins its batch_key.

    Order: landing time (log), else file modification time, newest first;
    then the larger file name. With ``valid``, invalid files never win and
    do not hide a valid one. The winner per key is a ``max_by`` aggregate
    (partially aggregated before the shuffle, so a batch key shared by a
    third of all files is not ranked in one task), joined back on batch_key.
    """
    when = F.coalesce(F.col("upload_datetime").cast("timestamp"), F.col("modified_at").cast("timestamp"))
    order = F.struct(when.alias("t"), F.col("source_file").alias("f"))  # NULL time sorts lowest
    cand = files if valid is None else files.where(valid)
    winners = cand.groupBy("batch_key").agg(F.max_by("source_file", order).alias("_winner"))
    flag = F.coalesce(F.col("source_file") == F.col("_winner"), F.lit(False))
    if valid is not None:
        flag = flag & F.coalesce(valid, F.lit(False))
    return files.join(winners, "batch_key", "left").withColumn("is_winner", flag).drop("_winner")


def replaced_keys(valid_files: DataFrame) -> DataFrame:
    """Batch keys that a run replaces: one row per key of any valid file."""
    return valid_files.select("batch_key").distinct()


def replace_batches(existing: DataFrame, incoming: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``existing`` outside ``keys``, plus all of ``incoming``.

    ``keys`` has one row per batch key (bounded by the number of files in the
    run), so the anti join broadcasts it when small and shuffles otherwise.
    """
    kept = existing.join(keys.select("batch_key").distinct(), "batch_key", "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def remove_batches(existing: DataFrame, keys: DataFrame) -> DataFrame:
    """M2: drop whole batches by key."""
    return existing.join(keys.select("batch_key").distinct(), "batch_key", "left_anti")


def batch_counts(facts: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """A1: rows per batch_key; with ``keys``, every key appears (0 when absent)."""
    counts = facts.groupBy("batch_key").agg(F.count(F.lit(1)).alias("row_count"))
    if keys is None:
        return counts
    return (
        keys.select("batch_key").distinct()
        .join(counts, "batch_key", "left")
        .select("batch_key", F.coalesce(F.col("row_count"), F.lit(0)).cast("long").alias("row_count"))
    )
