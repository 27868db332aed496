"""Incremental ingest into a :class:`FactStore`: only files that the ledger does
not answer for are read, and batches and ledger change in one commit."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.functions.names import base_name, is_workbook
from gridfold.operators.batches import replaced_keys
from gridfold.operators.checks import Check, check_report, check_table, raise_on_report
from gridfold.operators.checks import quarantine as write_quarantine
from gridfold.operators.ledger import LEDGER_SCHEMA, pending, run_entries, tombstones
from gridfold.operators.quality import CHECK_BATCH_KEY, CHECK_NOT_EMPTY, file_checks, raise_on_file_checks
from gridfold.plans.ingest import IngestError, IngestResult, _glob_escape, build_ingest, raise_on_file_errors
from gridfold.schema import DEFAULT_LAYOUT, FACT_COLUMNS, Layout
from gridfold.session import sql_conf, stage
from gridfold.sources.latest import lineage_log
from gridfold.sources.store import FactStore
from gridfold.sources.workbook import DECODE_CONF, Scan, decode, list_binary, split_scan, with_label


@dataclass
class LedgerRun:
    run_id: str
    taken: int  # files read by this run
    rows_written: int
    result: IngestResult | None  # None: there was nothing to do
    warning: str | None = None  # why lineage is NULL: the landing log could not be read


def pending_paths(store: FactStore, landing_dir: str, names: list[str] | None = None, reprocess: bool = False) -> list[str]:
    """Workbooks of the landing area that a run has to read (or the ``names``
    given), from the listing alone. As many strings as there are new files, which
    the driver's own listing held already."""
    listed = list_binary(store.spark, landing_dir).where(is_workbook(base_name("path"))).select(
        "path", base_name("path").alias("source_file"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    if names is not None:
        listed = listed.where(F.col("source_file").isin(list(names)))
    if not reprocess:
        listed = pending(listed, store.ledger(LEDGER_SCHEMA))
    return sorted(r["path"] for r in listed.select("path").collect())


def ledger_ingest(spark: SparkSession, landing_dir: str, store: FactStore, log: DataFrame | Callable[[], DataFrame] | None = None, layout: Layout = DEFAULT_LAYOUT,
                  names: list[str] | None = None, reprocess: bool = False, run_id: str | None = None, raise_on_check: bool = True,
                  raise_on_error: bool = True, checks: Sequence[Check] = (), quarantine: str | None = None) -> LedgerRun:
    """Ingest the workbooks that the ledger does not answer for.

    A file is taken when it is new, when it failed before, or when its stamp and its
    content changed. Of the files taken, the last valid one of each batch replaces
    it, as in :func:`gridfold.plans.ingest.run_ingest`; a later run's file replaces
    an earlier one's whatever its age. Files whose content is as the ledger
    has it are noted and left alone, so a batch once removed stays removed.
    ``reprocess`` takes every file (or those of ``names``) again.

    ``log``, the landing log (``LatestLandings.read`` or the whole one) or a function that
    opens it, gives lineage; one that can't be read leaves it NULL and is the
    run's ``warning``.

    After the commit, failing files or checks raise unless told not to. ``checks``
    are the caller's own, on each file's rows beside the default ones; with
    ``quarantine``, a folder, every failing group is written there under the run's id.
    """
    run_id = run_id or uuid.uuid4().hex
    paths = pending_paths(store, landing_dir, names, reprocess)
    if not paths:
        return LedgerRun(run_id, 0, 0, None)
    binary = list_binary(spark, [_glob_escape(p) for p in paths])
    with sql_conf(spark, DECODE_CONF):
        scan = split_scan(stage(spark, with_label(decode(binary, layout), layout), "ledger-grid"))
    return apply_with_ledger(store, scan, log, layout, reprocess, run_id, landing_dir, raise_on_check, raise_on_error, checks, quarantine)


def apply_with_ledger(store: FactStore, scan: Scan, log: DataFrame | Callable[[], DataFrame] | None, layout: Layout, reprocess: bool, run_id: str, where: str,
                      raise_on_check: bool = True, raise_on_error: bool = True, own: Sequence[Check] = (), quarantine: str | None = None) -> LedgerRun:
    """Replace the batches of decoded workbooks and note each file, in one commit."""
    spark = store.spark
    ledger, version = store.ledger(LEDGER_SCHEMA), store.snapshot().version + 1
    fresh = scan.files if reprocess else stage(spark, pending(scan.files, ledger, by="digest"), "ledger-fresh")
    unchanged = scan.files.join(fresh.select("source_file"), "source_file", "left_anti")
    log, warning = lineage_log(spark, log, fresh)
    ing = build_ingest(scan.grid, fresh, log, layout, materialize=True)
    facts = stage(spark, ing.facts, "ledger-facts")  # the body pass runs once; checks read one column of it
    checks = stage(spark, file_checks(ing.valid, facts), "ledger-checks")
    entries = run_entries(scan.files, ing.plan, checks, unchanged, ledger, run_id, version)
    taken = fresh.count()
    rows = store.replace(facts.where("is_winner").select(*FACT_COLUMNS), replaced_keys(ing.valid), entries)
    result = IngestResult(rows_written=rows, dropped_batches=[], files=ing.plan.select("source_file", "batch_key", "error", "is_winner"), checks=checks)
    report, place = None, None
    if own or quarantine:
        # two sets of different rows: the default checks know files without a row
        default = checks.select("source_file", "batch_key", F.when(~F.col("not_empty"), F.lit(CHECK_NOT_EMPTY)).otherwise(F.lit(CHECK_BATCH_KEY)).alias("check"), "row_count",
                                F.when(F.col("passed"), F.lit(0)).otherwise(F.col("row_count")).cast("long").alias("failed_rows"), "passed")
        report = default.unionByName(check_report(facts, own).where(F.col("check") != CHECK_NOT_EMPTY)) if own else default
        report = stage(spark, report, "ledger-report")
    if quarantine and not report.where("NOT passed").isEmpty():
        place = write_quarantine(report, quarantine, run_id)
    if raise_on_error and taken:
        raise_on_file_errors(result, where)
    if raise_on_check:
        if report is not None and not report.where("NOT passed").isEmpty():
            raise_on_report(report, store.root, place)
        raise_on_file_checks(checks, store.root)
    return LedgerRun(run_id, taken, rows, result, warning)


def remove_from_store(store: FactStore, keys: DataFrame, run_id: str | None = None) -> None:
    """M2: remove whole batches, so that no later run brings them back unless
    told to reprocess."""
    run_id = run_id or uuid.uuid4().hex
    ledger = store.ledger(LEDGER_SCHEMA)
    store.remove(keys, tombstones(ledger, keys, run_id, store.snapshot().version + 1))


def check_stored(store: FactStore, file: str, checks: Sequence[Check] | None = None, quarantine: str | None = None, run_id: str = "") -> int:
    """Check one source file's rows as a step of its own; only the buckets that
    hold them are opened."""
    return check_table(store.read(files=[file]), file, checks, store.root, quarantine, run_id)


__all__ = ["IngestError", "LedgerRun", "apply_with_ledger", "check_stored", "ledger_ingest", "pending_paths", "remove_from_store"]
