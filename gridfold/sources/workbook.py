"""S3: decode landed workbooks into grid rows, in parallel, one task per file batch.

``binaryFile`` lists and reads the files; ``mapInPandas`` turns each file's
bytes into one record per sheet row (``GRID_SCHEMA``) plus one status record
per file (``SCAN_SCHEMA``). A corrupt, legacy or oversized file becomes a
status record with ``scan_error`` set; it never fails the job.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.functions.names import base_name, is_workbook
from gridfold.schema import DEFAULT_LAYOUT, GRID_SCHEMA, SCAN_SCHEMA, Layout
from gridfold.sources.xlsx import read_first_sheet

# Files above this size are reported, not decoded (a binaryFile row holds the
# whole file; keep it well below the 2 GiB row limit and executor memory).
MAX_WORKBOOK_BYTES = 256 * 1024 * 1024
_CHUNK_ROWS = 20000
# Planning cost of opening one file when packing workbooks into scan tasks.
# The 4 MiB default packs ~32 small workbooks per task, and per-task overhead
# then dominates; with 64 KiB a task gets about its share of total bytes
# (spark.sql.files.maxPartitionBytes and the core count still bound it).
WORKBOOK_OPEN_COST = str(64 * 1024)
DECODE_CONF = {"spark.sql.files.openCostInBytes": WORKBOOK_OPEN_COST}

BINARY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("content", T.BinaryType(), True),
])

# decoder output: grid rows (row >= 1) and one status record per file (row = 0)
_RAW_SCHEMA = T.StructType(
    GRID_SCHEMA.fields
    + [f for f in SCAN_SCHEMA.fields if f.name not in ("source_file", "sheet_name")]
    + [T.StructField("digest", T.StringType())]  # of the file's bytes, on its status record
)


@dataclass
class Scan:
    grid: DataFrame  # GRID_SCHEMA
    files: DataFrame  # SCAN_SCHEMA
    buckets: int | None = None  # bucket count of the staged grid, if bucketed


def _decode_partition(layout: Layout, max_bytes: int):
    first, last = layout.first_col, layout.last_col

    def run(batches):
        cols = [f.name for f in _RAW_SCHEMA.fields]
        out: list[tuple] = []  # rows of several files, flushed in chunks
        for pdf in batches:
            for path, mtime, length, content in zip(
                pdf["path"], pdf["modificationTime"], pdf["length"], pdf["content"]
            ):
                name = path.rsplit("/", 1)[-1]
                sheet, error = None, None
                digest = None if content is None else hashlib.sha256(content).hexdigest()
                if name.lower().endswith(".xls"):
                    error = "legacy .xls workbooks are not supported"
                elif length > max_bytes or content is None:
                    error = f"file larger than {max_bytes} bytes"
                else:
                    mark = len(out)
                    try:
                        sheet, rows = read_first_sheet(bytes(content), first, last)
                        for r, cells in rows:
                            out.append((name, sheet, r, cells, None, None, None, None))
                            if len(out) >= _CHUNK_ROWS:
                                yield pd.DataFrame(out, columns=cols)
                                out, mark = [], 0
                    except Exception as e:  # noqa: BLE001 - corrupt zip / XML: a per-file error
                        del out[mark:]
                        sheet, error = None, f"unreadable workbook: {type(e).__name__}: {e}"[:500]
                # status record last: rows of a file that failed after a flush may
                # already be out, and the ingest plan only takes rows of files
                # without scan_error
                out.append((name, sheet, 0, None, mtime, int(length), error, digest))
            if len(out) >= _CHUNK_ROWS:
                yield pd.DataFrame(out, columns=cols)
                out = []
        if out:
            yield pd.DataFrame(out, columns=cols)

    return run


def list_binary(spark: SparkSession, landing_dir: str | list[str], recursive: bool = False) -> DataFrame:
    """Binary listing of ``landing_dir``, a folder or a list of files (content is
    read only if selected)."""
    reader = spark.read.format("binaryFile").schema(BINARY_SCHEMA)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(landing_dir)


def decode(binary: DataFrame, layout: Layout = DEFAULT_LAYOUT, max_bytes: int = MAX_WORKBOOK_BYTES) -> DataFrame:
    """Decode a binaryFile DataFrame; returns grid rows and status records
    in one frame (``row = 0`` marks a status record)."""
    from gridfold.session import ship_package

    ship_package(binary.sparkSession)
    wanted = binary.where(is_workbook(base_name("path")))
    small = wanted.where(F.col("length") <= max_bytes)
    # oversized files: listed without their content, reported as errors
    large = wanted.where(F.col("length") > max_bytes).select(
        "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content")
    )
    return small.unionByName(large).mapInPandas(_decode_partition(layout, max_bytes), _RAW_SCHEMA)


def with_label(raw: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> DataFrame:
    """Adds ``label`` (the column-B text) as its own column before staging,
    so band detection reads one small column, not every row's cell map."""
    return raw.withColumn("label", F.col("cells")[layout.first_col])


def split_scan(raw: DataFrame) -> Scan:
    extra = ["label"] if "label" in raw.columns else []
    grid = raw.where(F.col("row") > 0).select(*[f.name for f in GRID_SCHEMA.fields], *extra)
    noted = ["digest"] if "digest" in raw.columns else []
    files = raw.where(F.col("row") == 0).select(*[f.name for f in SCAN_SCHEMA.fields], *noted)
    return Scan(grid=grid, files=files)


def scan_workbooks(
    spark: SparkSession,
    landing_dir: str,
    layout: Layout = DEFAULT_LAYOUT,
    max_bytes: int = MAX_WORKBOOK_BYTES,
    stage_dir: str | None = None,
    buckets: int | str | None = None,
    choose=None,
) -> Scan:
    """Decode every workbook in ``landing_dir``.

    The decoded frame is read by several branches of the ingest plan, so it is
    written once as Parquet under ``stage_dir`` (default: a fresh folder in the
    session's checkpoint directory) and read back; each file is decoded once
    and a lost executor costs a re-read, not a re-decode.

    ``buckets``: stage as a table bucketed by source_file instead (for runs
    with too many files to broadcast their per-file plan): the per-file
    aggregates and the body join then run without shuffling the grid.
    ``"auto"`` asks ``choose(binary_listing)`` for the count (None = plain).
    """
    from gridfold.session import sql_conf, stage, stage_bucketed

    binary = list_binary(spark, landing_dir)  # one listing, reused by the count
    if buckets == "auto":
        buckets = choose(binary) if choose else None
    raw = with_label(decode(binary, layout, max_bytes), layout)
    with sql_conf(spark, DECODE_CONF):
        if buckets:
            scan = split_scan(stage_bucketed(spark, raw, "grid", "source_file", buckets, stage_dir))
        else:
            scan = split_scan(stage(spark, raw, "grid", stage_dir))
    scan.buckets = buckets or None
    return scan
