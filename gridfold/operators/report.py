"""A2 / L2: summaries over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_summary(facts: DataFrame) -> DataFrame:
    """A2: rows per (period_type, year, is_estimate), sorted by the same."""
    return (
        facts.groupBy("period_type", "year", "is_estimate")
        .agg(F.count(F.lit(1)).alias("row_count"))
        .orderBy("period_type", "year", "is_estimate")
    )


def stored_period_summary(summary: DataFrame) -> DataFrame:
    """A2 from the counts that a store keeps (``FactStore.summary``), without its facts."""
    return (
        summary.groupBy("period_type", "year", "is_estimate")
        .agg(F.sum("row_count").alias("row_count"))
        .orderBy("period_type", "year", "is_estimate")
    )


def stored_batches(summary: DataFrame) -> DataFrame:
    """A1 from the same: rows per batch and the file that they came from."""
    return summary.groupBy("batch_key", "source_file").agg(F.sum("row_count").alias("row_count"))
