"""S1/S2/S6/S7/S9 on real files and catalog tables; T11/T24; bucketed staging."""

import os
import uuid

import pytest
from fixtures import worked_rows, write_book
from pyspark.sql import functions as F

from gridfold.functions.names import uploader
from gridfold.operators.quality import check_scope, file_checks
from gridfold.plans.ingest import run_ingest
from gridfold.sources.landing import landing_files, log_landings, recent_landings, require_newest
from gridfold.sources.tables import append_landings, ensure_tables, read_facts


def test_s1_s2_listing_never_reads_content(spark, landing):
    for i, n in enumerate(["a.xlsx", "b.XLS", "c.csv", "d.xlsx"]):
        p = landing / n
        p.write_bytes(b"x" * (i + 1))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    os.utime(landing / "c.csv", (1_800_000_000, 1_800_000_000))  # newest, but not a workbook
    files = landing_files(spark, str(landing))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert require_newest(files) == "d.xlsx"
    with pytest.raises(ValueError, match="no workbook"):
        require_newest(files.where("false"))


def test_s6_s7_s9_log_and_history(spark):
    db = "l" + uuid.uuid4().hex[:8]
    facts, log = ensure_tables(spark, db)
    ensure_tables(spark, db)  # safe to re-run
    cols = {r.col_name: r.comment for r in spark.sql(f"DESCRIBE TABLE {facts}").collect() if r.col_name}
    assert cols["quarter"] == "1 to 4; empty for a whole year"
    ups = spark.createDataFrame([("Q3 報告.XLSX", 1280, "a@x.org", None, None, "2026-07-23 01:02:03"),
                                 ("b.xlsx", 10, "", "", "", "2026-07-23 01:02:04")],
                                "name string, size long, e string, p string, u string, ts string").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz"))
    rows = log_landings(ups, "name", "size", uploader("e", "p", "u"), now=F.col("ts")).withColumn(
        "uploaded_at", F.col("uploaded_at").cast("timestamp"))
    append_landings(rows, log)
    hist = recent_landings(spark.table(log), 10).collect()
    assert [h.file_name for h in hist] == ["b__unknown__20260723T010204Z.xlsx", "Q3_報告__a_x.org__20260723T010203Z.xlsx"]
    assert [h.size_text for h in hist] == ["10 B", "1.3 KB"]
    assert {h.status for h in hist} == {"landed"}


def test_t11_numeric_key_stays_string_and_t24_moved_batch(spark, tmp_path):
    db = "k" + uuid.uuid4().hex[:8]
    facts, _ = ensure_tables(spark, db)
    d1, d2 = tmp_path / "one", tmp_path / "two"
    d1.mkdir()
    d2.mkdir()
    write_book(d1 / "first.xlsx", "260723", worked_rows())
    run_ingest(spark, str(d1), facts, raise_on_check=False, raise_on_error=False)
    t = read_facts(spark, facts)
    assert dict(t.dtypes)["batch_key"] == "string"
    assert {r.batch_key for r in t.select("batch_key").distinct().collect()} == {"260723"}
    write_book(d2 / "second.xlsx", "260723", worked_rows())
    res = run_ingest(spark, str(d2), facts, raise_on_check=False, raise_on_error=False)
    assert res.rows_written == 11  # counted during the write
    t = read_facts(spark, facts)
    assert {r.source_file for r in t.select("source_file").distinct().collect()} == {"second.xlsx"}
    # the old file's rows are gone: checking it now finds nothing (C2 first)
    assert check_scope(t, "first.xlsx").count() == 0
    chk = file_checks(spark.createDataFrame([("first.xlsx", "260723")], "source_file string, batch_key string"),
                      check_scope(t, "first.xlsx")).first()
    assert chk.row_count == 0 and not chk.passed


def test_bucketed_staging_same_table_without_grid_shuffle(spark, tmp_path):
    db = "b" + uuid.uuid4().hex[:8]
    plain, _ = ensure_tables(spark, db, facts="plain", landing="plain_log")
    buck, _ = ensure_tables(spark, db, facts="buck", landing="buck_log")
    land = tmp_path / "land"
    land.mkdir()
    for i in range(6):
        write_book(land / f"f{i}.xlsx", f"BLB_2607{10 + i % 4}", worked_rows())
    run_ingest(spark, str(land), plain, raise_on_check=False, raise_on_error=False)
    from gridfold.plans.ingest import choose_buckets
    from gridfold.sources.workbook import list_binary
    assert choose_buckets(spark, list_binary(spark, str(land))) is None  # six files: broadcast
    assert choose_buckets(spark, list_binary(spark, str(land)), budget=1000) == int(
        spark.conf.get("spark.sql.shuffle.partitions"))
    res = run_ingest(spark, str(land), buck, raise_on_check=False, raise_on_error=False, broadcast_budget=1000)  # auto: bucketed
    assert res.rows_written == 4 * 11  # six files, four batch keys: four winners
    rows = lambda t: sorted(tuple(r) for r in read_facts(spark, t).collect())
    assert rows(plain) == rows(buck)
    from gridfold.plans.ingest import build_ingest
    from gridfold.sources.workbook import scan_workbooks
    scan = scan_workbooks(spark, str(land), buckets=4)
    facts = build_ingest(scan.grid, scan.files, broadcast_plan=False).facts
    facts.collect()
    plan = facts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    # the grid is never shuffled to meet the per-file plan (at most the
    # one-row-per-file plan side is)
    assert plan.count("Exchange hashpartitioning(source_file") <= 1
    assert "Exchange" not in plan.split("ShuffledHashJoin")[1].split("FileScan")[0]


def test_history_time_is_utc_in_any_session_zone(spark):
    log = spark.createDataFrame([("f.xlsx", "u", 1, "landed", "2026-07-23 01:02:03")],
                                "file_name string, uploaded_by string, size_bytes long, status string, uploaded_at string")
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        log = log.withColumn("uploaded_at", F.to_utc_timestamp(F.col("uploaded_at"), "UTC"))
        spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
        assert recent_landings(log).first().uploaded_at == "2026-07-23T01:02:03Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
