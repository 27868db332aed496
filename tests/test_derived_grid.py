"""Derived sheets: the same rows however they are staged, without moving sheet rows."""

import datetime as dt

import pytest

from gridfold.operators.shape import file_plan, to_long
from gridfold.plans.grids import WIDE_LAYOUT, derived_grid, order_facts, period_values, sheet_rows, sheet_values, label_rows


@pytest.fixture()
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    names = [(k, k % 2, None if k == 5 else f"C{k}") for k in range(1, 8)]
    orders = [(c, 100.0 + c, None if c == 6 else dt.date(1999 + i % 3, 1 + 4 * (i % 3), 2), None if i == 2 else ("1-A", "2-B")[i % 2])
              for c, _, _ in names for i in range(4)]
    orders += [(5, 1.0, dt.date(1997, 1, 1), "0-ONLY")]  # of a customer without a name: a label row all the same
    put("customer", names, "c_custkey long, c_nationkey long, c_name string")
    put("orders", orders, "o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string")
    return str(tmp_path)


def _rows(grid):
    return sorted((r.source_file, r.sheet_name, r.row, tuple(sorted(r.cells.items()))) for r in grid.collect())


def test_bucketed_grid_is_the_plain_one_and_its_body_stays(spark, tables):
    plain, split = derived_grid(spark, tables, "customer"), derived_grid(spark, tables, "customer", buckets=3)
    assert _rows(plain.grid) == _rows(split.grid) and plain.files.count() == split.files.count() == 5
    # rows 7.. are 0-ONLY, 1-A, 2-B after the label row of orders without a priority
    assert {r.label for r in split.grid.where("row = 9").select("label").collect()} == {"1-A"}
    plan = file_plan(split.files, split.grid, WIDE_LAYOUT)
    body = to_long(split.grid, plan.where("error IS NULL"), WIDE_LAYOUT)
    text = body._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 0
    assert body.count() == to_long(plain.grid, plan.where("error IS NULL"), WIDE_LAYOUT).count() > 0


def test_a_sheet_is_made_from_one_record(spark, tables):
    values = period_values(order_facts(spark, tables, "customer"))
    sheets = sheet_values(values)
    rows = sheet_rows(sheets, label_rows(sheets), "customer")
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in text and text.count("Join Inner") <= 3  # orders to customers, as often for the labels; the labels


def test_two_customers_of_one_name_and_period_are_an_error(spark, tables):
    spark.createDataFrame([(1, 0, "same"), (2, 0, "same"), (4, 0, "same")], "c_custkey long, c_nationkey long, c_name string").write.mode(
        "overwrite").parquet(f"{tables}/customer.parquet")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        derived_grid(spark, tables, "customer")


def test_rows_of_files_that_are_not_taken_go_before_headers_are_read(spark, tables):
    g = derived_grid(spark, tables, "customer")
    some = g.files.where("source_file = 'C3.xlsx'")
    plan = file_plan(some, g.grid, WIDE_LAYOUT)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join LeftSemi") == 2  # header row and marker rows
    whole = file_plan(g.files, g.grid, WIDE_LAYOUT).where("source_file = 'C3.xlsx'")
    assert plan.collect() == whole.collect() and plan.count() == 1


def test_kept_counts_run_the_body_pass_once(spark, tables, monkeypatch):
    from gridfold.plans import queries

    staged = []
    monkeypatch.setattr(queries, "stage", lambda s, df, label: staged.append((label, df.columns)) or df, raising=False)
    assert queries._kept_counts(spark, tables).count() >= 0
    assert [label for label, _ in staged] == ["kept-facts"]
