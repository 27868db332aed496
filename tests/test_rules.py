"""One test per rule (D) and trap (T) of the survey, on tiny literal frames."""

from decimal import Decimal

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridfold import functions as G
from gridfold.operators.quality import key_date


def one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,cls", [
    ("項目 (單位: 百萬)", "metric"), ("Q1 2026", "period"), ("Q4 2025 預估", "period"),
    ("FY 2026 預估", "period"), ("FY2026", "skipped"), ("Q5 2026", "skipped"), ("q1 2026", "skipped"),
    ("Q1 2026　預估", "period"), ("　Q1 2026　", "period"), ("Q1 ２０２６", "skipped"),
    ("Notes", "skipped"), ("Q1 2026 預估 x", "skipped"), ("單位 Q1 2026", "metric"),
])
def test_d3_header_classes(spark, text, cls):
    assert one(spark, G.header_class, text) == cls


def test_d9_t4_period_parse_on_stripped_header(spark):
    r = one(spark, G.parse_period, " Q2 2026 預估")
    assert (r.period_type, r.year, r.quarter, r.is_estimate) == ("Q", 2026, 2, True)
    r = one(spark, G.parse_period, "FY 2025")
    assert (r.period_type, r.year, r.quarter, r.is_estimate) == ("FY", 2025, None, False)


@pytest.mark.parametrize("text,out", [
    ("100", Decimal("100000000")), ("0.00000005", Decimal("0.1")), ("0.00000004", Decimal("0")),
    ("1e3", Decimal("1000000000")), ("1,234", None), ("n/a", None), ("", None), (" 12 ", Decimal("12000000")),
    ("9" * 32, None), ("9" * 26, None), ("9" * 25, Decimal("9" * 25) * 1000000), ("１２", Decimal("12000000")),
])
def test_d10_t1_t2_t19_scale_value(spark, text, out):
    got = one(spark, G.scale_value, text)
    assert (got is None and out is None) or got == out


def test_t1_value_type(spark):
    df = spark.createDataFrame([("1",)], "v string").select(G.scale_value("v").alias("x"))
    assert str(df.schema["x"].dataType) == "DecimalType(38,7)"


@pytest.mark.parametrize("text,blank", [
    (None, True), ("", True), ("   ", True), ("　", True), ("nan", True), (" NaN ", True), ("N/A", True),
    ("NULL", True), ("Revenue", False), (" x ", False), ("  NA", False), ("0", False),
])
def test_d2_t21_blank_labels(spark, text, blank):
    assert one(spark, G.is_blank_label, text) is blank


def test_t23_missing_metric_label(spark):
    assert one(spark, G.metric_label, None) == "nan"
    assert one(spark, G.metric_label, "#N/A") == "nan"
    assert one(spark, G.metric_label, " x ") == " x "


@pytest.mark.parametrize("key,ok", [("BLB_260723", True), ("Sheet1", False), ("BLB_2607", False),
                                    ("BLB_260231", False), ("BLB_260723\n", True), (None, False),
                                    ("XBLB_260723", False)])
def test_d14_readme_key_table(spark, key, ok):
    assert (one(spark, key_date, key) is not None) is ok


@pytest.mark.parametrize("sheet,digits,ok", [("BLB_260723", "260723", True), ("Sheet1", None, True),
                                             ("X1234567", "123456", False), ("BLB_260231", "260231", False),
                                             ("a 26 07 23", None, True)])
def test_d7_sheet_date_gate(spark, sheet, digits, ok):
    from gridfold.operators.shape import batch_keys
    df = spark.createDataFrame([("f", sheet)], "source_file string, sheet_name string")
    r = batch_keys(df).first()
    assert r.date_ok is ok
    assert one(spark, G.sheet_date_digits, sheet) == digits


@pytest.mark.parametrize("name,stem,ext", [("a.xlsx", "a", ".xlsx"), (".xlsx", ".xlsx", ""), ("a.b.XLSX", "a.b", ".XLSX"),
                                           ("noext", "noext", ""), ("..x", "..x", ""), ("d.x/y", "d.x/y", "")])
def test_t17_split_ext(spark, name, stem, ext):
    r = one(spark, G.split_ext, name)
    assert (r.stem, r.ext) == (stem, ext)


@pytest.mark.parametrize("part,out", [("Q3 report (final)", "Q3_report_final"), ("___", "file"), ("", "file"),
                                      ("季報 v2.1-x", "季報_v2.1-x"), ("a@b.com", "a_b.com"), ("é", "é")])
def test_d16_sanitize(spark, part, out):
    assert one(spark, G.sanitize_part, part) == out


def test_d16_unique_name(spark):
    df = spark.createDataFrame([("My File (1).XLSX", "a.b@x.org")], "n string, u string").select(
        G.unique_name("n", "u", F.lit("2026-07-23 01:02:03").cast("timestamp_ntz")).alias("r"))
    assert df.first().r == "My_File_1__a.b_x.org__20260723T010203Z.xlsx"


@pytest.mark.parametrize("name,out", [("a%20b+c.xlsx", "a b+c.xlsx"), ("a%zz.xlsx", "a%zz.xlsx"), (" x.xlsx ", "x.xlsx")])
def test_f4_decode_name(spark, name, out):
    assert one(spark, G.decode_name, name) == out


def test_f5_uploader(spark):
    df = spark.createDataFrame([("", None, "u"), (None, "", ""), ("e", "p", "u")], "a string, b string, c string")
    assert [r.r for r in df.select(G.uploader("a", "b", "c").alias("r")).collect()] == ["u", "unknown", "e"]


@pytest.mark.parametrize("size,text", [(None, "—"), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"),
                                       (1075, "1.0 KB"), (1126, "1.1 KB"), (1048576, "1.0 MB"), (3 * 1048576 // 2, "1.5 MB")])
def test_f12_t15_human_size(spark, size, text):
    assert one(spark, G.human_size, size, "bigint") == text


def test_d17_is_workbook(spark):
    got = [one(spark, G.is_workbook, n) for n in ["a.xlsx", "A.XLS", "a.xlsm", "a.xlsx.bak", "b.Xlsx"]]
    assert got == [True, True, False, False, True]


def test_t5_trim_unicode(spark):
    assert one(spark, G.trim_u, "　 文字版本 ") == "文字版本"


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab_.-@ 季x/é%")), max_size=12))
def test_sanitize_idempotent(spark, s):
    once = one(spark, G.sanitize_part, s)
    assert one(spark, G.sanitize_part, once) == once


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("a./_é季\n")), max_size=9), min_size=200, max_size=200))
def test_split_ext_matches_splitext_rule(spark, names):
    """The string-function split equals the regex statement of the rule and Python's splitext."""
    import os.path
    rule = r"(?s)^(.*[^./][^/]*)(\.[^./]*)$"
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", G.split_ext("n").alias("s"),
                    F.when(F.col("n").rlike(rule), F.regexp_extract("n", rule, 2)).otherwise(F.lit("")).alias("rx"))
    for row in got.collect():
        assert row.s.ext == row.rx, row.n
        assert row.s.stem + row.s.ext == row.n
        if "/" not in row.n:
            assert (row.s.stem, row.s.ext) == os.path.splitext(row.n), row.n


def test_estimate_suffix_is_a_parameter(spark):
    suffix = "E.ST"  # a dot in it is a dot
    for text, cls in [("Q1 2026 E.ST", "period"), ("Q1 2026 EXST", "skipped"), ("FY 2026", "period"), ("Q1 2026 預估", "skipped")]:
        assert one(spark, lambda c: G.header_class(c, estimate_suffix=suffix), text) == cls
    r = one(spark, lambda c: G.parse_period(c, suffix), "Q3 2026 E.ST")
    assert (r.period_type, r.year, r.quarter, r.is_estimate) == ("Q", 2026, 3, True)
    r = one(spark, lambda c: G.quarter_estimate(c, suffix), "Q3 2026 E.ST")
    assert (r.year, r.quarter) == (2026, 3)
    assert one(spark, lambda c: G.quarter_estimate(c, suffix), "Q3 2026 預估") is None


def test_changed_suffix_reaches_the_file_plan(spark):
    from gridfold.operators.shape import classify_headers, data_versions
    from gridfold.schema import Layout
    layout = Layout(estimate_suffix="EST")
    headers = spark.createDataFrame([("a", 2, "Q2 2026 EST"), ("a", 3, "Q4 2025")], "source_file string, col int, text string")
    got = data_versions(classify_headers(headers, layout), layout).collect()
    assert [tuple(r) for r in got] == [("a", "V_Q2_2026_ESTIMATE")]


def test_s8_equal_names_in_one_call(spark):
    from gridfold.sources.landing import ERR_NAME_TAKEN, ERR_NO_NAME, guard_new_names
    rows = [("n.xlsx", "a.xlsx", 1), ("n.xlsx", "a.xlsx", 2), ("n.xlsx", "a.xlsx", 1), ("old.xlsx", "b.xlsx", 1), (None, None, 1), (None, None, 2)]
    new = spark.createDataFrame(rows, "file_name string, original_name string, size int")
    log = spark.createDataFrame([("old.xlsx",), ("old.xlsx",), (None,)], "file_name string")
    got = sorted((r.file_name or "", r["size"], r.error or "") for r in guard_new_names(new, log).collect())
    assert got == [("", 1, ERR_NO_NAME), ("", 2, ERR_NO_NAME), ("n.xlsx", 1, ""), ("n.xlsx", 1, ERR_NAME_TAKEN),
                   ("n.xlsx", 2, ERR_NAME_TAKEN), ("old.xlsx", 1, ERR_NAME_TAKEN)]


def test_f15_error_counts_only_for_a_failed_task(spark):
    from gridfold.operators.runs import run_outcomes
    runs = spark.createDataFrame([(1, "TERMINATED", "FAILED", None), (2, "TERMINATED", "FAILED", None)],
                                 "run_id long, life_cycle_state string, result_state string, state_message string")
    log = spark.createDataFrame([(1, "ingest", 0, 0, None, "TIMEDOUT", "boom"), (2, "ingest", 0, 0, None, "FAILED", "boom")],
                                "run_id long, task_key string, attempt_number int, list_pos int, life_cycle_state string, result_state string, error string")
    got = {r.run_id: r.message for r in run_outcomes(runs, log).collect()}
    assert "boom" not in got[1] and got[2].endswith("boom")
