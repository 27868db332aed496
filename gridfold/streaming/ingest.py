"""Ingest each newly landed workbook once, in landing order, then check it.

``readStream.format("binaryFile")`` picks up new files; every micro-batch
runs the batch ingest plan (decode -> file plan -> body pass -> replace ->
per-file checks) through ``foreachBatch``. The replace is idempotent, so a
micro-batch repeated after a failure leaves the same table. There is no
event time in a landing, so no watermark: a late file simply replaces its
batch (last valid writer wins).
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridfold.operators.shape import cells_long
from gridfold.plans.ingest import apply_ingest, build_ingest
from gridfold.schema import DEFAULT_LAYOUT, Layout
from gridfold.session import checkpoint_dir, scratch_path, sql_conf, stage
from gridfold.sources.workbook import BINARY_SCHEMA, DECODE_CONF, decode, split_scan, with_label


def ingest_stream(spark: SparkSession, landing_dir: str, table: str, checkpoint: str | None = None,
                  layout: Layout = DEFAULT_LAYOUT, max_files: int = 1, log_table: str | None = None,
                  checks_path: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the landing stream. ``max_files=1`` applies files one per
    micro-batch, like a one-at-a-time job queue; larger values rely on the
    last-valid-file rule inside a batch and give the same table."""
    checkpoint = checkpoint or scratch_path(spark, "ingest-stream")
    src = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
           .option("maxFilesPerTrigger", max_files)
           .option("maxFileAge", "36500d")  # a file that arrives with an old time still counts
           .load(landing_dir))

    def each(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        raw = with_label(decode(batch, layout), layout)
        # staging path is fixed per micro-batch, so a repeated batch overwrites it
        with sql_conf(s, DECODE_CONF):
            scan = split_scan(stage(s, raw, "stream", f"{checkpoint.rstrip('/')}/stage/{batch_id}"))
        log = s.table(log_table) if log_table and s.catalog.tableExists(log_table) else None
        res = apply_ingest(s, build_ingest(scan.grid, scan.files, log, layout, materialize=True), table,
                           raise_on_check=False)
        if checks_path:
            res.checks.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(checks_path)

    w = src.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _fs_and_root(uri: str):
    import pyarrow.fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri[len("file:"):].replace("///", "/")
    fs, root = pafs.FileSystem.from_uri(uri)
    return fs, root


def write_workbooks(grid: DataFrame, out_dir: str) -> int:
    """Land one XLSX file per source_file of a grid, written by the tasks
    (one group per workbook: a workbook is one file). Returns files written."""
    from gridfold.sources.xlsx import workbook_bytes

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        fs, root = _fs_and_root(out_dir)
        name, sheet = pdf["source_file"].iloc[0], pdf["sheet_name"].iloc[0]
        rows: dict[int, dict[int, str]] = {}
        for r, c, t in zip(pdf["row"], pdf["col"], pdf["text"]):
            rows.setdefault(int(r), {})[int(c)] = t
        data = workbook_bytes(sheet, rows.items())
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root.rstrip('/')}/{name}") as f:
            f.write(data)
        return pd.DataFrame({"source_file": [name], "size_bytes": [len(data)]})

    from gridfold.session import ship_package

    ship_package(grid.sparkSession)
    return cells_long(grid).groupBy("source_file").applyInPandas(write, "source_file string, size_bytes long").count()


def stream_region_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q21: land the derived region workbooks as real XLSX files in the shared
    folder, ingest them with the stream (one file per micro-batch) into a
    fresh table, and return the table's rows."""
    from gridfold.plans.grids import WIDE_LAYOUT
    from gridfold.plans.queries import _grid
    from gridfold.sources.tables import ensure_fact_table, read_facts

    base = scratch_path(spark, "stream-q")
    landing = f"{base}/landing"
    write_workbooks(_grid(spark, sf_dir).grid, landing)
    table = f"default.gridfold_stream_{uuid.uuid4().hex[:12]}"
    ensure_fact_table(spark, table, location=f"{base}/table")
    q = ingest_stream(spark, landing, table, f"{base}/checkpoint", WIDE_LAYOUT, max_files=1)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return read_facts(spark, table)


__all__ = ["ingest_stream", "stream_region_workbooks", "write_workbooks", "checkpoint_dir"]
