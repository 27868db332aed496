"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT_CKPT = "/tmp/gridfold-checkpoints"


def get_spark(master: str | None = None, app: str = "gridfold", shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """A session with the settings every plan here assumes: UTC, ANSI, AQE."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session that names none (tests) gets a default; on a
    cluster a machine-local folder would be unreadable by other executors,
    so a missing setting is an error there.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = os.environ.get("GRIDFOLD_CHECKPOINT_DIR")
        if not d and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = d or _LOCAL_DEFAULT_CKPT
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(spark: SparkSession, df: DataFrame, label: str, path: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` but keeps a columnar, prunable copy:
    later branches read only the columns and row groups they need. The
    shuffle files of the write go when it ends; nothing reads them again.
    ``batch_rows``: rows that reach Python tasks at once, fewer than Spark's
    10,000 where rows hold whole texts, which JVM and worker both buffer.
    """
    path = path or scratch_path(spark, label)
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        conf["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    with sql_conf(spark, conf):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(spark: SparkSession, df: DataFrame, label: str, key: str, buckets: int,
                   path: str | None = None) -> DataFrame:
    """Like :func:`stage`, but written as a table bucketed by ``key``.

    Writing buckets needs no shuffle (each task writes its rows to their
    bucket files). Read back through the catalog, the scan is already
    hash-partitioned by ``key``: aggregates and joins on ``key`` over it add
    no exchange on this side. Used for the decoded grid when the per-file
    plan is too large to broadcast.
    """
    path = path or scratch_path(spark, label)
    name = f"gridfold_{label.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


@contextmanager
def sql_conf(spark: SparkSession, settings: dict[str, str]):
    """Set SQL confs for the actions run inside the block, then restore."""
    prev = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in prev.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an input with fewer partitions than task slots before
    CPU-heavy row work; a no-op once the input is large enough to have at
    least one partition per slot."""
    if os.environ.get("GRIDFOLD_SPREAD", "1") == "0":
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gridfold`` importable by the Python workers of this context, for
    sessions whose workers do not have the package on their path. The zip is
    a driver-local file that ``addPyFile`` serves to the executors through
    the driver's own file server, so it needs no file system beyond Spark's.
    Once per application."""
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="gridfold-ship-"), "gridfold.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(dirpath, n)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
