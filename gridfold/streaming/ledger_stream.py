"""R1 with side outputs that happen once: a file stream into a :class:`FactStore`.

Each micro-batch is one commit of facts and ledger rows (a row per file, errors
included), under a run id made of the query and the batch id. A micro-batch that
is replayed after a failure finds its run id in the ledger and does nothing; its quarantine
folder is named after the run id, so that one too exists once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridfold.operators.checks import Check
from gridfold.operators.ledger import LEDGER_SCHEMA
from gridfold.plans.ledger_ingest import LedgerRun, apply_with_ledger
from gridfold.schema import DEFAULT_LAYOUT, Layout
from gridfold.session import scratch_path, sql_conf, stage
from gridfold.sources.store import FactStore
from gridfold.sources.workbook import BINARY_SCHEMA, DECODE_CONF, decode, split_scan, with_label


def apply_micro_batch(store: FactStore, batch: DataFrame, run_id: str, stage_path: str, log_table: str | None = None, layout: Layout = DEFAULT_LAYOUT,
                      raise_on_error: bool = False, raise_on_check: bool = False, checks: Sequence[Check] = (), quarantine: str | None = None) -> LedgerRun | None:
    """Ingest the workbooks of one micro-batch, unless the ledger has its run id."""
    spark = batch.sparkSession
    if not store.ledger(LEDGER_SCHEMA).where(F.col("run_id") == run_id).isEmpty():
        return None
    with sql_conf(spark, DECODE_CONF):
        scan = split_scan(stage(spark, with_label(decode(batch, layout), layout), "stream", stage_path))
    if scan.files.isEmpty():
        return None
    log = (lambda: spark.table(log_table)) if log_table else None  # not there or not readable: lineage is NULL
    return apply_with_ledger(store, scan, log, layout, False, run_id, "the landing stream", raise_on_check, raise_on_error, checks, quarantine)


def ledger_stream(spark: SparkSession, landing_dir: str, store: FactStore, checkpoint: str | None = None, layout: Layout = DEFAULT_LAYOUT,
                  max_files: int = 1, log_table: str | None = None, available_now: bool = True, raise_on_error: bool = False,
                  raise_on_check: bool = False, checks: Sequence[Check] = (), quarantine: str | None = None) -> StreamingQuery:
    """Start the landing stream into ``store``.

    With ``raise_on_error`` or ``raise_on_check`` a failing micro-batch ends the query after its
    commit; started again, the query goes on behind it. ``max_files`` changes how many
    files share a commit, not the table: files come in order of modification
    time, within a micro-batch the last valid one of a batch wins, and a later micro-batch wins over an earlier one.
    """
    checkpoint = (checkpoint or scratch_path(spark, "ledger-stream")).rstrip("/")
    query = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    files = (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("maxFilesPerTrigger", max_files)
             .option("maxFileAge", "36500d").load(landing_dir))  # a file that arrives with an old time still counts

    def each(batch: DataFrame, batch_id: int) -> None:
        target = FactStore(batch.sparkSession, store.root)
        apply_micro_batch(target, batch, f"{query}-{batch_id}", f"{checkpoint}/stage/{batch_id}", log_table, layout,
                          raise_on_error, raise_on_check, checks, quarantine)

    w = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
