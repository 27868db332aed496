"""Declared checks in one pass, and the quarantine."""

import pytest
from pyspark.sql import functions as F

from gridfold.operators.checks import CheckFailure, GroupCheck, RowCheck, batch_key_dated, check_groups, check_report, check_table, failing_checks
from gridfold.operators.quality import key_report, check_batch_key

CHECKS = [
    batch_key_dated(), RowCheck("value_set", "value IS NOT NULL"), RowCheck("not_negative", lambda: F.col("value") >= 0),
    GroupCheck("few_rows", "count(*)", lambda n: n <= 3), GroupCheck("some_value", "max(value)", lambda m: m > 1),
]


def _facts(spark):
    rows = [("a.xlsx", "BLB_260101", 1.0), ("a.xlsx", "BLB_260101", -2.0), ("a.xlsx", "BLB_260101", None), ("b.xlsx", "BLB_260231", 5.0),
            ("b.xlsx", None, 0.5)] + [("c.xlsx", "BLB_260105", 3.0)] * 4
    return spark.createDataFrame(rows, "source_file string, batch_key string, value double").repartition(3)


def test_each_check_counts_its_failures(spark):
    got = {(r["check"], r["source_file"], r["batch_key"]): (r["row_count"], r["failed_rows"], r["passed"]) for r in check_report(_facts(spark), CHECKS).collect()}
    assert len(got) == 1 + 5 * 4
    assert got["not_empty", None, None] == (9, 0, True)
    assert got["batch_key_date", "b.xlsx", "BLB_260231"] == (1, 1, False) and got["batch_key_date", "b.xlsx", None] == (1, 1, False)
    assert got["value_set", "a.xlsx", "BLB_260101"] == (3, 1, False)
    assert got["not_negative", "a.xlsx", "BLB_260101"] == (3, 2, False)  # NULL is no pass
    assert got["few_rows", "c.xlsx", "BLB_260105"] == (4, 4, False)
    assert got["some_value", "a.xlsx", "BLB_260101"] == (3, 3, False) and got["some_value", "c.xlsx", "BLB_260105"] == (4, 0, True)
    whole = {r["check"]: (r["failed_groups"], r["failed_rows"]) for r in failing_checks(check_report(_facts(spark), CHECKS)).collect()}
    assert whole == {"not_empty": (0, 0), "batch_key_date": (2, 2), "value_set": (1, 1), "not_negative": (1, 2), "few_rows": (1, 4), "some_value": (2, 4)}


def test_default_check_equals_the_key_report(spark):
    facts = _facts(spark)
    got = {(r["batch_key"], r["row_count"], r["passed"]) for r in check_report(facts, by=("batch_key",)).where("check = 'batch_key_date'").collect()}
    assert got == {(r["batch_key"], r["row_count"], r["passed"]) for r in key_report(check_batch_key(facts)).collect()}
    with pytest.raises(ValueError, match="names"):
        check_report(facts, [RowCheck("x", "true"), RowCheck("x", "true")])


def test_five_checks_take_one_scan_and_one_shuffle_of_the_rows(spark, tmp_path):
    _facts(spark).write.parquet(str(tmp_path / "f"))
    groups = check_groups(spark.read.parquet(str(tmp_path / "f")), CHECKS)
    plan = groups._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1, plan
    # what follows reads the groups, not the rows
    report = check_report(spark.read.parquet(str(tmp_path / "f")), CHECKS)
    assert str(tmp_path / "f") not in report._jdf.queryExecution().executedPlan().toString()


def test_all_bad_keys_are_in_quarantine(spark, tmp_path):
    bad = spark.range(10_000).select(F.lit("f.xlsx").alias("source_file"), F.concat(F.lit("Sheet"), "id").alias("batch_key"), F.lit(1.0).alias("value"))
    for _ in range(2):  # a repeated run leaves one copy
        with pytest.raises(CheckFailure, match="10000 groups, 10000 rows") as e:
            check_table(bad, checks=CHECKS[:1], quarantine_path=str(tmp_path / "q"), run_id="r1")
        assert e.value.quarantine in str(e.value) and len(str(e.value)) < 1000
    found = spark.read.parquet(str(tmp_path / "q"))
    assert found.select("batch_key").distinct().count() == found.count() == 10_000
    assert {r[0] for r in found.select("run_id").distinct().collect()} == {"r1"}


def test_check_table_by_file(spark):
    facts = _facts(spark)
    assert check_table(facts, "c.xlsx") == 4
    with pytest.raises(CheckFailure, match="no rows"):
        check_table(facts, "missing.xlsx")
    with pytest.raises(CheckFailure, match="BLB_260231"):
        check_table(facts, "b.xlsx")
