"""The newest landing of each file name, kept up to date beside the log.

Lineage needs one record per name. Ranking the whole log for it costs more with
every landing; this table takes new log records as they come and rewrites only the
buckets of their names, so a run reads one row per name.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.session import stage
from gridfold.sources.store import FactStore, StoreConflict

_COLUMNS = ["file_name", "uploaded_by", "uploaded_at"]
#: Spark's error class of a file that its reader can't decode.
UNREADABLE = "[FAILED_READ_FILE"


class LatestLandings:
    """One record per file name in a :class:`FactStore`. ``ts_type`` counts when it is made."""

    def __init__(self, spark: SparkSession, root: str, ts_type: T.DataType = T.TimestampType(), buckets: int = 64):
        schema = T.StructType([T.StructField("file_name", T.StringType()), T.StructField("uploaded_by", T.StringType()),
                               T.StructField("uploaded_at", ts_type)])
        self.spark, self.store = spark, FactStore(spark, root, schema, key="file_name", buckets=buckets, summary=())

    def add(self, log: DataFrame, attempts: int = 5) -> int:
        """Merge log records, in any order and also ones that it has already;
        returns the names they hold. Another writer's commit in between is merged with."""
        new = stage(self.spark, _newest(log), "landings-new")
        names = new.select("file_name")
        for attempt in range(attempts):
            base = self.store.snapshot()
            held = self.store.read(version=base.version)
            held = held.join(names.withColumnRenamed("file_name", "_name"), F.col("file_name").eqNullSafe(F.col("_name")), "left_semi")
            try:
                return self.store.replace(_newest(new.unionByName(held)), names, action="landings", base=base)
            except StoreConflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def read(self) -> DataFrame:
        """``(file_name, uploaded_by, uploaded_at)``, a log of one record per name."""
        return self.store.read()


def _newest(log: DataFrame) -> DataFrame:
    """One record per name: the newest, of equal times the larger ``uploaded_by``,
    as in :func:`gridfold.operators.lineage.latest_landing`, by an aggregate that combines before its shuffle."""
    # max skips nulls in neither field of a struct, and orders them first
    last = F.max(F.struct("uploaded_at", "uploaded_by")).alias("last")
    return log.select(_COLUMNS).groupBy("file_name").agg(last).select("file_name", "last.uploaded_by", "last.uploaded_at")


def lineage_log(spark: SparkSession, log: DataFrame | Callable[[], DataFrame] | None, names: DataFrame) -> tuple[DataFrame | None, str | None]:
    """The newest log record of each of a run's files (``names``, column ``source_file``),
    or no log and the reason where it can't be read: lineage is then NULL.

    ``log`` may be a function, so that a log whose opening fails counts as one that
    can't be read. The records are written out here, once, so that a broken file of
    the log shows now and not in the middle of the run. Only a log that is not there,
    lacks a column or holds a broken file counts; a failed cluster fails the run."""
    if log is None:
        return None, None
    try:
        rows = log() if callable(log) else log
        wanted = names.select(F.col("source_file").alias("file_name")).distinct()
        return stage(spark, _newest(rows.join(wanted, "file_name", "left_semi")), "landing-log"), None
    except (AnalysisException, Py4JJavaError) as e:
        reason = next((line for line in str(e).splitlines() if isinstance(e, AnalysisException) or UNREADABLE in line), None)
        if reason is None:
            raise
        return None, f"landing log not read: {reason.strip()}"


__all__ = ["LatestLandings", "lineage_log"]
