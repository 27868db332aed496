"""One N-file run equals the same files applied one by one."""

import os
import shutil
import uuid

import pytest
from fixtures import worked_rows, write_book
from pyspark.sql import functions as F

from gridfold.plans.ingest import run_ingest
from gridfold.schema import FACT_COLUMNS
from gridfold.sources.tables import append_landings, ensure_tables, read_facts
from gridfold.streaming.ingest import ingest_stream


def _variant(scale):
    rows = worked_rows()
    rows[7] = {c: (str(float(t) * scale) if c > 2 and t.replace(".", "").isdigit() else t) for c, t in rows[7].items()}
    return rows


def _land(spark, root, log_table):
    """Files in landing order, each with its own mtime and log record."""
    specs = [
        ("old1.xlsx", "BLB_260101", _variant(1)),
        ("old3.xlsx", "BLB_260103", _variant(3)),
        ("a1.xlsx", "BLB_260101", _variant(5)),
        ("bad.xlsx", "BLB_260101", {r: ({c: t for c, t in cs.items() if c != 2} if r == 4 else cs)
                                    for r, cs in worked_rows().items()}),
        ("a2.xlsx", "BLB_260101", _variant(7)),
        ("empty.xlsx", "BLB_260103", {**worked_rows(), 6: {2: "圖"}, 12: {2: "文字版本"}}),
        ("other.xlsx", "BLB_260104", _variant(2)),
    ]
    paths = []
    for i, (name, sheet, rows) in enumerate(specs):
        p = write_book(root / name, sheet, rows)
        os.utime(p, (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))
        paths.append(p)
    log = spark.createDataFrame(
        [(n, f"user{i}", 1, "landed", f"2026-01-01 00:{i:02d}:00") for i, (n, _, _) in enumerate(specs)],
        "file_name string, uploaded_by string, size_bytes long, status string, uploaded_at string",
    ).withColumn("uploaded_at", F.col("uploaded_at").cast("timestamp"))
    append_landings(log, log_table)
    return paths


def _table(spark, db, name):
    facts, landing = ensure_tables(spark, db, facts=name, landing=name + "_log")
    return facts, landing


def _rows(spark, table):
    return sorted(tuple(r) for r in read_facts(spark, table).select(*FACT_COLUMNS).collect())


def test_n_files_equal_sequential_runs(spark, tmp_path):
    db = "t" + uuid.uuid4().hex[:8]
    land = tmp_path / "land"
    land.mkdir()
    seq_t, seq_log = _table(spark, db, "seq")
    all_t, all_log = _table(spark, db, "batch")
    paths = _land(spark, land, seq_log)
    append_landings(spark.table(seq_log), all_log)
    # one at a time, in landing order
    for i, p in enumerate(paths):
        d = tmp_path / f"one{i}"
        d.mkdir()
        shutil.copy2(p, d / p.name)
        run_ingest(spark, str(d), seq_t, seq_log, raise_on_check=False, raise_on_error=False)
    # the first two files first (an earlier run), then all the rest at once
    early = tmp_path / "early"
    early.mkdir()
    for p in paths[:2]:
        shutil.copy2(p, early / p.name)
    run_ingest(spark, str(early), all_t, all_log, raise_on_check=False, raise_on_error=False)
    rest = tmp_path / "rest"
    rest.mkdir()
    for p in paths[2:]:
        shutil.copy2(p, rest / p.name)
    res = run_ingest(spark, str(rest), all_t, all_log, raise_on_check=False, raise_on_error=False)
    assert _rows(spark, seq_t) == _rows(spark, all_t)
    got = {r.batch_key: r.source_file for r in read_facts(spark, all_t).select("batch_key", "source_file").distinct().collect()}
    assert got == {"BLB_260101": "a2.xlsx", "BLB_260104": "other.xlsx"}  # 260103 emptied by a valid empty file
    assert res.dropped_batches == ["BLB_260103"]
    users = {r.upload_user for r in read_facts(spark, all_t).where("source_file = 'a2.xlsx'").collect()}
    assert users == {"user4"}
    checks = {r.source_file: r.passed for r in res.checks.collect()}
    assert checks == {"a1.xlsx": True, "a2.xlsx": True, "empty.xlsx": False, "other.xlsx": True}  # T25: a1 checked too
    errs = {r.source_file: r.error for r in res.files.collect()}
    assert errs["bad.xlsx"] and errs["a2.xlsx"] is None
    # re-running the same files changes nothing (idempotent replace)
    run_ingest(spark, str(rest), all_t, all_log, raise_on_check=False, raise_on_error=False)
    assert _rows(spark, seq_t) == _rows(spark, all_t)


def test_stream_equals_batch(spark, tmp_path):
    db = "s" + uuid.uuid4().hex[:8]
    land = tmp_path / "land"
    land.mkdir()
    b_t, b_log = _table(spark, db, "batch")
    s_t, _ = _table(spark, db, "stream")
    _land(spark, land, b_log)
    run_ingest(spark, str(land), b_t, b_log, raise_on_check=False, raise_on_error=False)
    q = ingest_stream(spark, str(land), s_t, str(tmp_path / "ckpt"), max_files=1, log_table=b_log,
                      checks_path=str(tmp_path / "checks"))
    q.awaitTermination()
    assert q.exception() is None
    assert _rows(spark, s_t) == _rows(spark, b_t)
    n_checks = spark.read.parquet(str(tmp_path / "checks")).count()
    assert n_checks == 6  # every valid file is checked once, in its own micro-batch


def test_one_file_run_named_or_newest(spark, tmp_path):
    from gridfold.plans.ingest import ingest_one, resolve_file
    db = "o" + uuid.uuid4().hex[:8]
    facts, _ = _table(spark, db, "one")
    land = tmp_path / "land"
    land.mkdir()
    a = write_book(land / "a b+c.xlsx", "BLB_260723", worked_rows())
    b = write_book(land / "newer.xlsx", "BLB_260724", worked_rows())
    os.utime(a, (1_700_000_000, 1_700_000_000))
    os.utime(b, (1_700_000_100, 1_700_000_100))
    assert resolve_file(spark, str(land)) == "newer.xlsx"
    assert resolve_file(spark, str(land), "a%20b+c.xlsx ") == "a b+c.xlsx"
    ingest_one(spark, str(land), facts, "a%20b+c.xlsx")
    ingest_one(spark, str(land), facts)
    got = {r.batch_key: r.source_file for r in read_facts(spark, facts).select("batch_key", "source_file").distinct().collect()}
    assert got == {"BLB_260723": "a b+c.xlsx", "BLB_260724": "newer.xlsx"}


def test_first_run_creates_the_table(spark, tmp_path):
    from gridfold.plans.ingest import run_ingest
    db = "c" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {db}")
    land = tmp_path / "land"
    land.mkdir()
    write_book(land / "a.xlsx", "BLB_260723", worked_rows())
    res = run_ingest(spark, str(land), f"{db}.facts")
    assert res.rows_written == 11
    assert spark.catalog.tableExists(f"{db}.facts") and not spark.catalog.tableExists(f"{db}.landing_log")
    parts = [r[0] for r in spark.sql(f"SHOW PARTITIONS {db}.facts").collect()]
    assert parts == ["batch_key=BLB_260723"]


def test_drop_many_emptied_partitions(spark):
    from gridfold.sources.tables import ensure_fact_table, write_batches
    t = f"default.d_{uuid.uuid4().hex[:8]}"
    ensure_fact_table(spark, t)
    rows = spark.range(1200).select(
        F.lit("m").alias("metric"), F.lit("Q").alias("period_type"), F.lit(2026).alias("year"), F.lit(1).alias("quarter"),
        F.lit(False).alias("is_estimate"), F.lit(1).cast("decimal(38,7)").alias("value"), F.lit("f").alias("source_file"),
        F.lit(None).cast("string").alias("upload_user"), F.lit(None).cast("timestamp").alias("upload_datetime"),
        F.lit("V").alias("data_version"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("batch_key"))
    assert write_batches(spark, t, rows) == 1200
    gone = [f"k{i}" for i in range(0, 1200, 2)]
    keep = rows.where(F.col("id") % 2 == 1)
    assert write_batches(spark, t, keep.limit(0), gone) == 0
    assert spark.table(t).count() == 600
    assert len(spark.sql(f"SHOW PARTITIONS {t}").collect()) == 600


def test_failed_files_fail_the_run(spark, tmp_path):
    from gridfold.plans.ingest import IngestError, ingest_one, run_ingest
    db = "f" + uuid.uuid4().hex[:8]
    facts, _ = _table(spark, db, "one")
    land = tmp_path / "land"
    land.mkdir()
    with pytest.raises(IngestError, match="no workbook"):
        run_ingest(spark, str(land), facts)
    write_book(land / "a.xlsx", "BLB_260723", worked_rows())
    (land / "bad.xlsx").write_bytes(b"no zip")
    (land / "note.csv").write_bytes(b"x")
    with pytest.raises(IngestError, match="1 of 2 workbooks failed: bad.xlsx") as e:
        run_ingest(spark, str(land), facts)
    assert e.value.result.rows_written == read_facts(spark, facts).count() > 0  # the valid file landed
    for name in ("bad.xlsx", "note.csv"):
        with pytest.raises(IngestError):
            ingest_one(spark, str(land), facts, name)
