"""Benchmark: headline queries and the N-file workbook ingest.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1)
and prints one JSON line. Each query is executed in full through the
``noop`` sink (no driver collect). The N-file ingest lands one real XLSX
workbook per customer in the shared checkpoint folder (setup, not timed),
then times one run over all of them against a sample of one-file runs
(the one-workbook-per-run mode of the original job), extrapolated.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "long_facts", "long_facts_bench", "lineage", "row_band", "header_classes", "file_errors",
    "wide_unpivot", "scaled_values", "replace_batches", "remove_batch", "period_summary",
    "key_check", "check_report", "latest_attempt", "run_outcomes", "landing_log", "unique_names",
    "recent_landings", "newest_file", "batch_dates", "data_versions", "check_totals", "file_checks", "check_set",
    "sink_replace", "ledger_ingest",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    one_file_samples = int(os.environ.get("BENCH_ONE_FILE_SAMPLES", "5"))
    from gridfold.session import get_spark, scratch_path

    spark = get_spark(f"local[{cpus}]", app="gridfold-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    from gridfold.plans import queries as Q
    from gridfold.plans.grids import WIDE_LAYOUT
    from gridfold.plans.ledger_ingest import ledger_ingest
    from gridfold.sources.store import FactStore
    from gridfold.streaming.ingest import write_workbooks

    timings: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up

    t = time.time()
    Q._grid(spark, sf, "region")
    timings["derive_region_grid"] = time.time() - t
    t = time.time()
    Q._grid(spark, sf, "customer")
    timings["derive_customer_grid"] = time.time() - t

    for name in HEADLINE:
        t = time.time()
        _run(Q.QUERIES[name](spark, sf))
        timings[name] = time.time() - t

    # N-file ingest from real workbooks, one per customer
    landing = scratch_path(spark, "bench-landing")
    n_files = write_workbooks(Q._grid(spark, sf, "customer").grid, landing)
    local = landing.removeprefix("file:")
    for i, name in enumerate(sorted(os.listdir(local))):  # fixed times, so that the same workbook wins each batch in every run
        if name.endswith(".xlsx"):
            os.utime(os.path.join(local, name), (1_700_000_000 + i, 1_700_000_000 + i))
    store = FactStore(spark, scratch_path(spark, "bench-store"))
    t = time.time()
    rows = ledger_ingest(spark, landing, store, layout=WIDE_LAYOUT, raise_on_check=False, raise_on_error=False).rows_written
    timings["ingest_xlsx_all_files"] = time.time() - t
    t = time.time()
    ledger_ingest(spark, landing, store, layout=WIDE_LAYOUT, raise_on_check=False, raise_on_error=False)
    timings["ingest_xlsx_nothing_new"] = time.time() - t

    # one file per run, on a sample, as the one-workbook-per-job mode does
    one = FactStore(spark, scratch_path(spark, "bench-one"))
    files = sorted(n for n in os.listdir(local) if n.endswith(".xlsx"))[:one_file_samples]
    t = time.time()
    for name in files:
        ledger_ingest(spark, f"{landing}/{name}", one, layout=WIDE_LAYOUT, raise_on_check=False, raise_on_error=False)
    per_file = (time.time() - t) / max(1, len(files))
    timings["one_file_per_run_avg"] = per_file

    headline_total = sum(timings[k] for k in HEADLINE)
    out = {
        "metric": "headline_queries_total_sec",
        "value": round(headline_total, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in timings.items()},
        "sf": sf,
        "cpus": int(cpus),
        "xlsx_files": int(n_files),
        "xlsx_rows_written": int(rows),
        "xlsx_rows_per_sec": round(rows / timings["ingest_xlsx_all_files"], 1),
        "one_file_per_run_projected_sec": round(per_file * n_files, 1),
        "n_file_speedup_vs_one_per_run": round(per_file * n_files / timings["ingest_xlsx_all_files"], 1),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
