"""The landing area and its log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridfold.functions.display import display_status, human_size, iso_time
from gridfold.functions.names import base_name, is_workbook, unique_name, uploader, utc_wall
from gridfold.schema import LANDED

# ---------------------------------------------------------------------------
# Landing errors.
# ---------------------------------------------------------------------------
ERR_NO_NAME = "No file provided."
ERR_NOT_WORKBOOK = "Only Excel files (.xlsx, .xls) are accepted."
ERR_NAME_TAKEN = "A file with this name has already landed."
HISTORY_LIMIT = 10
# ---------------------------------------------------------------------------


def landing_files(spark: SparkSession, landing_dir: str) -> DataFrame:
    """``(path, file_name, modificationTime, length)``; never reads content."""
    from gridfold.sources.workbook import list_binary

    return list_binary(spark, landing_dir).select(
        "path", base_name("path").alias("file_name"), "modificationTime", "length"
    )


def newest_file(files: DataFrame, name_col: str = "file_name", time_col: str = "modificationTime",
                tie_col: str | None = None) -> DataFrame:
    """The most recently modified workbook, as a one-row frame.

    A global top-1: each partition keeps its own newest row before the single
    final merge, so nothing but one row per partition moves. Ties go to the
    larger ``tie_col`` (default: the name).
    """
    tie = tie_col or name_col
    return (
        files.where(is_workbook(F.col(name_col)))
        .orderBy(F.col(time_col).desc(), F.col(tie).desc())
        .limit(1)
    )


def require_newest(files: DataFrame, where: str = "the landing area", **kw) -> str:
    """S2 as the job does it: the newest workbook's name, or an error."""
    row = newest_file(files, **kw).first()
    if row is None:
        raise ValueError(f"{where} holds no workbook to ingest")
    return row[kw.get("name_col", "file_name")]


def log_landings(uploads: DataFrame, name: Column | str, size: Column | str, user: Column,
                 now: Column | None = None) -> DataFrame:
    """S7 (+F2, F5, F13): one landing-log record per upload, status ``landed``.

    ``user`` is an identity column (e.g. ``uploader(a, b, c)``); ``now`` the
    landing time (default ``current_timestamp()``), taken as UTC wall clock
    for the name.
    """
    now_col = now if now is not None else F.current_timestamp()
    n = F.col(name) if isinstance(name, str) else name
    s = F.col(size) if isinstance(size, str) else size
    wall = now_col if now is not None else F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), now_col.cast("timestamp_ntz"))
    return uploads.select(
        unique_name(n, user, wall).alias("file_name"),
        user.alias("uploaded_by"),
        s.cast("long").alias("size_bytes"),
        F.lit(LANDED).alias("status"),
        now_col.alias("uploaded_at"),
        n.alias("original_name"),
    )


def guard_new_names(incoming: DataFrame, log: DataFrame, *order: str) -> DataFrame:
    """S8 + D17: flag uploads that must not land.

    Adds ``error``: no name, not a workbook, or a file name already in the log
    or of an upload before it in this call (a landed file is never
    overwritten). Uploads of one call count in the order of the columns
    ``order``, by default of all but the two names; of equal rows one lands.
    Names are matched by SHA-256; the log side is de-duplicated first (partial
    aggregation), and the order within a name reuses the join's partitioning.
    """
    # A non-nullable key: a NULL name is never taken, and no inferred
    # IS NOT NULL filter gets pushed down (that would evaluate a derived
    # name expression once more, below any repartition, at the scan).
    key = F.coalesce(F.sha2("file_name", 256), F.lit(""))
    taken = log.select(key.alias("_k")).distinct().withColumn("_taken", F.lit(True))
    j = incoming.withColumn("_k", key).join(taken, "_k", "left")
    err = (
        F.when(F.coalesce(F.col("original_name"), F.lit("")) == "", F.lit(ERR_NO_NAME))
        .when(~is_workbook(F.col("original_name")), F.lit(ERR_NOT_WORKBOOK))
        .when(F.col("_taken"), F.lit(ERR_NAME_TAKEN))
    )
    order = order or tuple(c for c in incoming.columns if c not in ("file_name", "original_name"))
    turn = W.partitionBy("_k", F.col("error").isNull()).orderBy(*order)
    late = F.col("error").isNull() & F.col("file_name").isNotNull() & (F.col("_turn") > 1)
    j = j.withColumn("error", err).withColumn("_turn", F.row_number().over(turn))
    return j.withColumn("error", F.when(late, F.lit(ERR_NAME_TAKEN)).otherwise(F.col("error"))).drop("_k", "_taken", "_turn")


def recent_landings(log: DataFrame, n: int = HISTORY_LIMIT, utc_ts: Column | None = None) -> DataFrame:
    """S9/L1 + F11/F12/F16: newest ``n`` landings for display.

    ``utc_ts``: the landing time as UTC wall clock (default: ``uploaded_at``,
    converted from the session time zone when it is a TIMESTAMP).
    Planned as TakeOrderedAndProject: a per-partition top-n, then one merge.
    """
    ts = utc_ts if utc_ts is not None else utc_wall(log, "uploaded_at")
    return (
        log.orderBy(F.col("uploaded_at").desc(), F.col("file_name").desc())
        .limit(n)
        .select(
            "file_name",
            F.col("uploaded_by").alias("user"),
            "size_bytes",
            display_status("status").alias("status"),
            iso_time(ts).alias("uploaded_at"),
            human_size("size_bytes").alias("size_text"),
        )
    )


__all__ = [
    "guard_new_names", "landing_files", "log_landings", "newest_file", "recent_landings",
    "require_newest", "uploader",
]
