"""The ingest ledger: what became of each landed file, run by run.

A run takes the files that the ledger does not answer for; removing a batch
leaves a tombstone for each file that delivered it, so the next run does not
bring the batch back. Frames only; :class:`gridfold.sources.store.FactStore`
commits ledger rows together with the batches they speak of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANDED, SUPERSEDED, FAILED, REMOVED, UNCHANGED = "landed", "superseded", "failed", "removed", "unchanged"
#: Outcomes after which a file is not taken again; a failed one is.
SETTLED = (LANDED, SUPERSEDED, REMOVED, UNCHANGED)

LEDGER_SCHEMA = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("digest", T.StringType()),  # sha256 of the file's bytes, hex
    T.StructField("size_bytes", T.LongType()),
    T.StructField("modified_at", T.TimestampType()),
    T.StructField("batch_key", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("version", T.LongType()),  # of the snapshot that the run made
])
LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]


def latest_entries(ledger: DataFrame) -> DataFrame:
    """The newest entry of each file: a partial aggregate, no window."""
    newest = F.max_by(F.struct(*LEDGER_COLUMNS), F.struct("version", "run_id"))
    return ledger.groupBy("source_file").agg(newest.alias("e")).select("e.*")


def pending(files: DataFrame, ledger: DataFrame, by: str = "stamp") -> DataFrame:
    """Rows of ``files`` that no settled entry answers for.

    ``by='stamp'`` compares name, size and modification time, which a listing
    has; ``by='digest'`` name and content, once the content was read.
    """
    same = ["source_file", "size_bytes", "modified_at"] if by == "stamp" else ["source_file", "digest"]
    settled = latest_entries(ledger).where(F.col("outcome").isin(*SETTLED)).select(*[F.col(c).alias(f"_{c}") for c in same])
    return files.join(settled, [files[c].eqNullSafe(settled[f"_{c}"]) for c in same], "left_anti")


def run_entries(files: DataFrame, plan: DataFrame, checks: DataFrame, unchanged: DataFrame, ledger: DataFrame, run_id: str, version: int) -> DataFrame:
    """Ledger rows of a run: one per decoded file.

    ``files`` are the decoder's status rows with their digest, ``plan`` says for
    each file taken its batch key, error and whether it won its batch, ``checks``
    how many rows it has. ``unchanged`` files (content as before) keep the
    batch key of their last entry and get a new stamp.
    """
    stamp = files.select("source_file", "digest", "size_bytes", "modified_at")
    taken = (
        plan.select("source_file", "batch_key", "error", "is_winner").join(stamp, "source_file")
        .join(checks.select("source_file", "row_count"), "source_file", "left")
        .withColumn("outcome", F.when(F.col("error").isNotNull(), FAILED).when(F.col("is_winner"), LANDED).otherwise(SUPERSEDED))
    )
    last = latest_entries(ledger).select("source_file", "batch_key", "row_count", F.col("outcome").alias("_was"))
    same = unchanged.select("source_file").join(stamp, "source_file").join(last, "source_file").withColumn("error", F.lit(None).cast("string"))
    same = same.withColumn("outcome", F.when(F.col("_was") == REMOVED, REMOVED).otherwise(F.col("_was")))
    run = [F.lit(run_id).alias("run_id"), F.lit(version).cast("long").alias("version")]
    cols = [c for c in LEDGER_COLUMNS if c not in ("run_id", "version")]
    return taken.select(*cols, *run).unionByName(same.select(*cols, *run))


def tombstones(ledger: DataFrame, keys: DataFrame, run_id: str, version: int) -> DataFrame:
    """Ledger rows that mark every file of the removed batches as removed."""
    gone = keys.select(F.col("batch_key").alias("_key")).distinct()
    was = latest_entries(ledger).where(F.col("outcome").isin(LANDED, SUPERSEDED))
    return was.join(gone, was["batch_key"].eqNullSafe(gone["_key"]), "left_semi").select(
        *[F.lit(REMOVED).alias(c) if c == "outcome" else F.lit(run_id).alias(c) if c == "run_id"
          else F.lit(version).cast("long").alias(c) if c == "version" else F.lit(0).cast("long").alias(c) if c == "row_count" else F.col(c) for c in LEDGER_COLUMNS])


def ledger_report(ledger: DataFrame) -> DataFrame:
    """One row per file: its newest entry, and how many runs spoke of it."""
    return latest_entries(ledger).join(ledger.groupBy("source_file").agg(F.count(F.lit(1)).alias("entries")), "source_file")
