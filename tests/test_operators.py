from pyspark.sql import functions as F

from gridfold.functions.display import classify_run
from gridfold.operators.batches import batch_counts, remove_batches, replace_batches, winning_files
from gridfold.operators.lineage import latest_landing, with_lineage
from gridfold.operators.quality import (check_batch_key, check_totals, file_checks, key_report, raise_on_failure,
                                        run_checks)
from gridfold.operators.runs import latest_attempts
from gridfold.operators.shape import band_rows, grid_from_cells
import pytest

CELLS = "source_file string, sheet_name string, row int, col int, text string"


def grid(spark, cells):
    return grid_from_cells(spark.createDataFrame(cells, CELLS))


def test_d1_band_first_markers_and_empty_when_reversed(spark):
    c = [("a", "s", r, 2, t) for r, t in [(5, "x"), (6, "文字版本"), (7, "in"), (8, "文字版本"), (9, "in2"), (10, "圖"),
                                         (11, "out"), (12, "圖")]]
    c += [("b", "s", r, 2, t) for r, t in [(5, "圖"), (6, "x"), (7, "文字版本"), (8, "y")]]
    c += [("c", "s", r, 2, t) for r, t in [(5, "top"), (6, " 圖 ")]]
    got = sorted((r.source_file, r.row) for r in band_rows(grid(spark, c)).collect())
    assert got == [("a", 7), ("a", 8), ("a", 9), ("c", 5)]


def test_j1_latest_landing_tie_break(spark):
    log = spark.createDataFrame([("f", "u1", "2026-01-01 00:00:00"), ("f", "u2", "2026-01-01 00:00:00"),
                                 ("f", "u0", "2025-01-01 00:00:00"), ("g", "v", "2026-02-01 00:00:00")],
                                "file_name string, uploaded_by string, uploaded_at string").withColumn(
        "uploaded_at", F.col("uploaded_at").cast("timestamp"))
    got = {r.file_name: r.upload_user for r in latest_landing(log).collect()}
    assert got == {"f": "u2", "g": "v"}
    files = spark.createDataFrame([("f",), ("h",)], "source_file string")
    got = {r.source_file: r.upload_user for r in with_lineage(files, log).collect()}
    assert got == {"f": "u2", "h": None}


def test_m1_replace_is_idempotent_and_keeps_others(spark):
    ex = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3), ("k3", 4)], "batch_key string, v int")
    inc = spark.createDataFrame([("k1", 10)], "batch_key string, v int")
    keys = spark.createDataFrame([("k1",), ("k3",)], "batch_key string")
    once = replace_batches(ex, inc, keys)
    twice = replace_batches(once, inc, keys)
    assert sorted(once.collect()) == sorted(twice.collect()) == sorted(
        spark.createDataFrame([("k1", 10), ("k2", 3)], "batch_key string, v int").collect())
    rem = remove_batches(ex, spark.createDataFrame([("k2",)], "batch_key string"))
    assert {r.batch_key: r.row_count for r in batch_counts(rem, ex.select("batch_key")).collect()} == {
        "k1": 2, "k2": 0, "k3": 1}


def test_w3_last_valid_file_wins(spark):
    f = spark.createDataFrame([("a", "k", "2026-01-01 00:00:00", None), ("b", "k", "2026-01-02 00:00:00", None),
                               ("c", "k", None, "2026-01-03 00:00:00"), ("d", "j", None, None)],
                              "source_file string, batch_key string, upload_datetime string, modified_at string")
    f = f.select("source_file", "batch_key", F.col("upload_datetime").cast("timestamp").alias("upload_datetime"),
                 F.col("modified_at").cast("timestamp").alias("modified_at"))
    got = {r.source_file: r.is_winner for r in winning_files(f).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": True}


def test_w2_t14_latest_attempt(spark):
    log = spark.createDataFrame([(1, "ingest", None, 0, "x"), (1, "ingest", 0, 1, "y"), (1, "ingest", 2, 2, "z"),
                                 (1, "ingest", 2, 3, "w"), (1, "quality_check", None, 4, "q")],
                                "run_id long, task_key string, attempt_number int, list_pos int, result_state string")
    got = {r.task_key: r.result_state for r in latest_attempts(log).collect()}
    assert got == {"ingest": "w", "quality_check": "q"}


def test_c1_c4_reports_and_raise(spark):
    df = spark.createDataFrame([("BLB_260723", "a"), ("BLB_260723", "a"), ("Sheet1", "a")], "batch_key string, source_file string")
    rep = key_report(check_batch_key(df))
    assert [(r.batch_key, r.row_count, r.passed) for r in rep.collect()] == [("BLB_260723", 2, True), ("Sheet1", 1, False)]
    t = check_totals(rep).first()
    assert (t.total_rows, t.failed_rows, t.failed_keys) == (3, 1, 1)
    with pytest.raises(AssertionError, match=r"1 of 3 rows .* 'Sheet1'"):
        raise_on_failure(run_checks(df))
    with pytest.raises(AssertionError, match="no rows"):
        raise_on_failure(run_checks(df.where("false")))
    assert raise_on_failure(run_checks(df.where("batch_key = 'BLB_260723'"))) == 2


def test_c2_file_with_no_rows_appears(spark):
    files = spark.createDataFrame([("a", "BLB_260101"), ("b", "BLB_260102")], "source_file string, batch_key string")
    facts = spark.createDataFrame([("a",)], "source_file string")
    got = {r.source_file: (r.row_count, r.passed) for r in file_checks(files, facts).collect()}
    assert got == {"a": (1, True), "b": (0, False)}


@pytest.mark.parametrize("life,result,ingest,quality,q_err,expect", [
    ("RUNNING", None, None, None, None, ("Ingesting data...", "Data quality check", 65, None)),
    ("QUEUED", None, None, None, None, ("Job queued...", "Data quality check", 40, None)),
    ("RUNNING", None, "SUCCESS", None, None, ("Data ingested", "Running data quality check...", 85, None)),
    ("TERMINATED", "SUCCESS", "SUCCESS", "SUCCESS", None,
     ("Data ingested", "Data quality check passed", 100, "Data has been ingested into the table and passed the quality check.")),
    ("TERMINATED", "FAILED", "SUCCESS", "FAILED", "AssertionError: Quality check FAILED: x",
     ("Data ingested", "Data quality check failed", 100, "Quality check FAILED: x")),
    ("TERMINATED", "FAILED", "FAILED", None, None, ("Ingestion failed", "Data quality check skipped", 100, "Error: boom")),
    ("WAITING", None, None, None, None, ("Ingesting data...", "Data quality check", 50, None)),
])
def test_f14_f15_run_outcomes(spark, life, result, ingest, quality, q_err, expect):
    df = spark.createDataFrame([(life, result, "boom", ingest, None, quality, q_err)],
                               "l string, r string, m string, ir string, ie string, qr string, qe string")
    o = df.select(classify_run("l", "r", "m", "ir", "ie", "qr", "qe").alias("o")).first().o
    assert (o.step1, o.step2, o.percent, o.message) == expect


def test_run_outcomes_uses_latest_attempt(spark):
    from gridfold.operators.runs import run_outcomes
    runs = spark.createDataFrame([(1, "TERMINATED", "FAILED", ""), (2, "RUNNING", None, None)],
                                 "run_id long, life_cycle_state string, result_state string, state_message string")
    log = spark.createDataFrame([(1, "ingest", 0, 0, "TERMINATED", "FAILED", "boom"),
                                 (1, "ingest", 1, 1, "TERMINATED", "SUCCESS", None),
                                 (1, "quality_check", None, 2, "TERMINATED", "FAILED", "AssertionError: bad key"),
                                 (2, "ingest", 1, 0, "RUNNING", None, None)],
                                "run_id long, task_key string, attempt_number int, list_pos int, "
                                "life_cycle_state string, result_state string, error string")
    got = {r.run_id: (r.step1, r.step2, r.percent, r.message) for r in run_outcomes(runs, log).collect()}
    assert got == {1: ("Data ingested", "Data quality check failed", 100, "bad key"),
                   2: ("Ingesting data...", "Data quality check", 65, None)}
