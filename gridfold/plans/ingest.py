"""The ingest plan: grid rows + file list (+ landing log) -> long facts.

    scan -> file plan (headers, band, metric, periods, version, errors)
         -> lineage -> last valid file per batch -> body pass (join + explode)
         -> per-file checks -> replace batches

All stages are DataFrame operations; the only Python on executors is the
workbook decoder. The per-file plan has one row per file: it is broadcast to
the body pass when its size bound (files and header cells) fits the budget,
otherwise the body is hash-joined on source_file (AQE splits a skewed
file's partition), or, for very many files, the grid is staged bucketed by
source_file so that neither side of that join moves the grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.operators.batches import winning_files
from gridfold.operators.lineage import with_lineage
from gridfold.operators.quality import file_checks, raise_on_file_checks
from gridfold.operators.shape import file_plan, to_long
from gridfold.schema import DEFAULT_LAYOUT, FACT_COLUMNS, Layout
from gridfold.session import stage

# Broadcast budget for the per-file plan, and a conservative size model of
# it: a fixed part per file plus one period struct per header cell at most
# (period columns are a subset of the header cells in the column window).
BROADCAST_BUDGET_BYTES = 256 * 1024 * 1024
PLAN_BYTES_PER_FILE = 512
PLAN_BYTES_PER_HEADER = 64
BROADCAST_MAX_FILES = BROADCAST_BUDGET_BYTES // (PLAN_BYTES_PER_FILE + 11 * PLAN_BYTES_PER_HEADER)


@dataclass
class Ingest:
    plan: DataFrame  # one row per file: error, batch_key, lineage, is_winner ...
    facts: DataFrame  # long facts of every valid file, plus is_winner
    checks: DataFrame  # per valid file: row_count, batch_date, not_empty, key_ok, passed

    @property
    def incoming(self) -> DataFrame:
        """Rows that replace their batches: the winning file of each key."""
        return self.facts.where(F.col("is_winner")).select(*FACT_COLUMNS)

    @property
    def valid(self) -> DataFrame:
        return self.plan.where(F.col("error").isNull())

    @property
    def errors(self) -> DataFrame:
        return self.plan.where(F.col("error").isNotNull()).select("source_file", "batch_key", "error")


def plan_size_bound(files: DataFrame, grid: DataFrame, layout: Layout = DEFAULT_LAYOUT) -> int:
    """Upper bound, in bytes, of the per-file plan: counts the status rows and
    the header cells (both cheap: one row per file, and header-row cells with
    ``row = header_row`` pushed into the scan)."""
    from gridfold.operators.shape import header_cells

    return (files.count() * PLAN_BYTES_PER_FILE
            + header_cells(grid, layout).count() * PLAN_BYTES_PER_HEADER)


def fits_broadcast(files: DataFrame, grid: DataFrame | None = None, layout: Layout = DEFAULT_LAYOUT,
                   budget: int = BROADCAST_BUDGET_BYTES) -> bool:
    """Size check for broadcasting the per-file plan."""
    if grid is None:  # files only: assume the default column window per file
        return files.limit(BROADCAST_MAX_FILES + 1).count() <= BROADCAST_MAX_FILES
    return plan_size_bound(files, grid, layout) <= budget


def build_ingest(grid: DataFrame, files: DataFrame, log: DataFrame | None = None,
                 layout: Layout = DEFAULT_LAYOUT, broadcast_plan: bool | None = None,
                 broadcast_budget: int = BROADCAST_BUDGET_BYTES, materialize: bool = False) -> Ingest:
    """Lazy ingest plan over decoded (or derived) grid rows.

    ``files`` follows ``SCAN_SCHEMA``; ``log`` ``LANDING_SCHEMA``.
    ``broadcast_plan=None`` decides by a size bound of the plan (files and
    header cells counted, see :func:`plan_size_bound`). ``materialize`` writes
    the per-file plan (one row per file) once to the shared folder, so the
    body pass, the checks and the report do not each recompute it from the
    grid (the sink path runs several actions on it).
    """
    ts_type = "timestamp"
    if log is not None:
        ts_type = log.schema["uploaded_at"].dataType.simpleString()
    plan = with_lineage(file_plan(files, grid, layout), log, ts_type, names=files)
    if materialize:
        # the winner rule reads the plan twice (aggregate + join back)
        plan = stage(grid.sparkSession, plan, "file-plan")
    plan = winning_files(plan, valid=F.col("error").isNull())
    valid = plan.where(F.col("error").isNull())
    if broadcast_plan is None:
        if materialize:
            # the staged plan can be measured directly: one tiny aggregate
            bound = plan.agg(
                (F.count(F.lit(1)) * PLAN_BYTES_PER_FILE
                 + F.coalesce(F.sum(F.size("periods")), F.lit(0)) * PLAN_BYTES_PER_HEADER).alias("b")
            ).first()["b"]
            broadcast_plan = bound <= broadcast_budget
        else:
            broadcast_plan = fits_broadcast(files, grid, layout, broadcast_budget)
    body_plan = valid.select(
        "source_file", "periods", "metric_col", "band_start", "band_end",
        "upload_user", "upload_datetime", "data_version", "batch_key", "is_winner",
    )
    facts = to_long(grid, body_plan, layout, broadcast_plan=broadcast_plan).select(*FACT_COLUMNS, "is_winner")
    checks = file_checks(valid, facts)
    return Ingest(plan=plan, facts=facts, checks=checks)


@dataclass
class IngestResult:
    rows_written: int
    dropped_batches: list[str]
    files: DataFrame  # per file: source_file, batch_key, error, is_winner
    checks: DataFrame  # per valid file check report


def choose_buckets(spark: SparkSession, binary: DataFrame, budget: int = BROADCAST_BUDGET_BYTES) -> int | None:
    """Bucket count for staging, or None to stage plainly and broadcast.

    Counts the workbooks of a binaryFile listing (metadata only, the listing
    the decoder reads). When even the fixed part of the per-file plan (no
    header cells counted) exceeds the broadcast budget, the plan can never be
    broadcast, so the grid is staged bucketed by source_file. Otherwise it is
    staged plainly and the exact bound (files and header cells, after
    decoding) picks broadcast or a hash join.
    """
    from gridfold.functions.names import base_name, is_workbook

    n = binary.select("path").where(is_workbook(base_name("path"))).count()
    if n * PLAN_BYTES_PER_FILE <= budget:
        return None
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def run_ingest(spark: SparkSession, landing_dir: str, table: str, log_table: str | None = None,
               layout: Layout = DEFAULT_LAYOUT, raise_on_check: bool = True,
               buckets: int | str | None = "auto", broadcast_budget: int = BROADCAST_BUDGET_BYTES,
               raise_on_error: bool = True) -> IngestResult:
    """Decode every workbook in ``landing_dir`` and replace their batches in
    ``table`` (created if absent); then check each file's rows.

    Equals applying the files one at a time in landing order: per batch key
    the last valid file wins, whole.

    ``buckets`` stages the decoded grid bucketed by source_file; ``None``
    stages it plainly and broadcasts the per-file plan when its size bound
    allows (else hash-joins); ``"auto"`` picks by :func:`choose_buckets`.

    After the write, a folder without a workbook or a file with an error
    raises :class:`IngestError` (``raise_on_error=False``: errors are rows of
    ``files`` only).
    """
    from gridfold.sources.workbook import scan_workbooks

    scan = scan_workbooks(spark, landing_dir, layout, buckets=buckets,
                          choose=lambda binary: choose_buckets(spark, binary, broadcast_budget))
    buckets = scan.buckets
    log = spark.table(log_table) if log_table and spark.catalog.tableExists(log_table) else None
    ing = build_ingest(scan.grid, scan.files, log, layout, broadcast_plan=False if buckets else None,
                       broadcast_budget=broadcast_budget, materialize=True)
    result = apply_ingest(spark, ing, table, raise_on_check=False)
    if raise_on_error:
        raise_on_file_errors(result, landing_dir)
    if raise_on_check:
        raise_on_file_checks(result.checks, table)
    return result


class IngestError(ValueError):
    """Workbooks of a run that could not be ingested. ``result`` holds the
    run's outcome, its ``files`` every failing file; the valid files landed."""

    def __init__(self, message: str, result: IngestResult | None = None):
        super().__init__(message)
        self.result = result


def raise_on_file_errors(result: IngestResult, where: str, shown: int = 20) -> None:
    """Raise when the run found no workbook, or one with an error. The
    message names ``shown`` files and the number of all."""
    n, failed = result.files.agg(F.count("*"), F.count("error")).first()
    if not n:
        raise IngestError(f"{where} holds no workbook to ingest", result)
    if failed:
        some = result.files.where("error IS NOT NULL").orderBy("source_file").limit(shown).collect()
        text = "; ".join(f"{r['source_file']}: {r['error']}" for r in some)
        raise IngestError(f"{failed} of {n} workbooks failed: {text}" + "; ..." * (failed > shown), result)


def apply_ingest(spark: SparkSession, ing: Ingest, table: str, raise_on_check: bool = True) -> IngestResult:
    """Write an :class:`Ingest` into ``table`` and report."""
    from gridfold.sources.tables import write_batches

    if not spark.catalog.tableExists(table):
        from gridfold.sources.tables import ensure_fact_table
        ensure_fact_table(spark, table)
    facts = ing.facts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        checks = file_checks(ing.valid, facts).persist(StorageLevel.MEMORY_AND_DISK)
        winners = ing.plan.where(F.col("is_winner")).select("source_file", "batch_key")
        # replaced keys that get no row: the winner kept nothing
        drop_keys = [r["batch_key"] for r in winners.join(checks.where(F.col("row_count") == 0)
                                                          .select("source_file"), "source_file").collect()]
        written = write_batches(spark, table, facts.where(F.col("is_winner")), drop_keys)
    finally:
        facts.unpersist()
    result = IngestResult(
        rows_written=written,
        dropped_batches=drop_keys,
        files=ing.plan.select("source_file", "batch_key", "error", "is_winner"),
        checks=checks,
    )
    if raise_on_check:
        raise_on_file_checks(checks, table)
    return result


def resolve_file(spark: SparkSession, landing_dir: str, file_name: str | None = None) -> str:
    """S2 + F4: the file a one-file run ingests: the named file (URL-decoded,
    stripped; ``+`` kept), else the newest workbook in the landing area."""
    from gridfold.functions.names import decode_name
    from gridfold.sources.landing import landing_files, require_newest

    if file_name and file_name.strip():
        return spark.range(1).select(decode_name(F.lit(file_name)).alias("n")).first()["n"]
    return require_newest(landing_files(spark, landing_dir), where=landing_dir)


def ingest_one(spark: SparkSession, landing_dir: str, table: str, file_name: str | None = None,
               log_table: str | None = None, layout: Layout = DEFAULT_LAYOUT,
               raise_on_check: bool = True, raise_on_error: bool = True) -> IngestResult:
    """One-file run, as a job triggered per upload: resolve the file, ingest
    it, replace its batch, check its rows. Same plan as a many-file run."""
    name = resolve_file(spark, landing_dir, file_name)
    path = f"{landing_dir.rstrip('/')}/{_glob_escape(name)}"
    return run_ingest(spark, path, table, log_table, layout, raise_on_check=raise_on_check, raise_on_error=raise_on_error)


def _glob_escape(name: str) -> str:
    """Hadoop paths are globs: escape the glob characters of a literal name."""
    return "".join("\\" + c if c in "*?[]{}\\" else c for c in name)
