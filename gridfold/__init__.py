"""gridfold: period-table workbook ingestion and checks on Spark.

Main entry points:

* :func:`gridfold.plans.ingest.run_ingest` — decode every workbook in a
  landing folder and replace their batches in the fact table, then check.
* :func:`gridfold.plans.ingest.ingest_one` — the one-file run (named file,
  else the newest workbook).
* :func:`gridfold.plans.ingest.build_ingest` — the lazy plan over grid rows.
* :func:`gridfold.streaming.ingest.ingest_stream` — the same as a file stream.
* :mod:`gridfold.sources.landing` — landing names, log and history view.
* :mod:`gridfold.operators.quality` — batch-key checks and reports.
"""

__version__ = "0.1.0"
