"""Who landed each file and when, from the landing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_landing(log: DataFrame) -> DataFrame:
    """Newest log record per file_name: ``(file_name, upload_user, upload_datetime)``.

    Ties on ``uploaded_at`` go to the larger ``uploaded_by`` so the answer is
    deterministic. ``row_number() = 1`` is planned as a per-group top-1
    (WindowGroupLimit), so each partition keeps one row per name before the
    window sort.
    """
    w = Window.partitionBy("file_name").orderBy(F.col("uploaded_at").desc_nulls_last(),
                                                F.col("uploaded_by").desc_nulls_last())
    return (
        log.select("file_name", "uploaded_by", "uploaded_at")
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") == 1)
        .select(
            "file_name",
            F.col("uploaded_by").alias("upload_user"),
            F.col("uploaded_at").alias("upload_datetime"),
        )
    )


def with_lineage(per_file: DataFrame, log: DataFrame | None, ts_type: str = "timestamp",
                 names: DataFrame | None = None) -> DataFrame:
    """Adds ``upload_user`` and ``upload_datetime`` to a per-file frame keyed by
    ``source_file``; both NULL when the log has no record (or no log).
    ``names``: the run's file names (``source_file``), if cheaper to get
    than from ``per_file``."""
    if log is None:
        return per_file.withColumns({
            "upload_user": F.lit(None).cast("string"),
            "upload_datetime": F.lit(None).cast(ts_type),
        })
    # Only the log rows of this run's files matter: semi-join first, so a run
    # of a few files does not rank every landing ever logged. The window that
    # follows is keyed like the semi join, so it needs no second shuffle.
    names = (names if names is not None else per_file).select(F.col("source_file").alias("file_name")).distinct()
    relevant = log.join(names, "file_name", "left_semi")
    latest = latest_landing(relevant).withColumnRenamed("file_name", "source_file")
    return per_file.join(latest, "source_file", "left")
