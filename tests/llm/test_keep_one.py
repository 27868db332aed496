import pytest

from gridfold.llm.simhash_dedup import keep_one

X = "whole orbit season little planet above mention neither " * 6
Y = "red house green river yellow stone purple cloud silver bird " * 6


def test_a_doc_id_with_two_texts_loses_neither_group(spark):
    rows = [(1, X), (1, Y), (2, Y), (3, X), (1, X), (None, Y)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r.doc_id, r.text) for r in keep_one(df).collect()) == sorted([(1, X), (1, Y)])


@pytest.mark.parametrize("order", [1, -1])
def test_which_row_stays_is_defined(spark, order):
    near = [(5, X), (5, X.upper()), (6, X)]
    got = keep_one(spark.createDataFrame(near[::order], "doc_id long, text string").coalesce(1)).collect()
    assert [r.doc_id for r in got] == [5]
    assert got[0].text == keep_one(spark.createDataFrame(near, "doc_id long, text string").repartition(3)).first().text


def test_columns_of_any_name_stay(spark):
    rows = [(1, X, "a", 2, 3), (2, X, "b", 2, 3), (1, X, "a", 2, 3), (3, None, "c", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, stays int, root int")
    got = sorted(tuple(r) for r in keep_one(df).collect())
    assert got == [(1, X, "a", 2, 3), (3, None, "c", 0, 0)]
    assert keep_one(df.limit(0)).count() == 0


def test_only_rows_that_may_go_are_moved(spark):
    """The rows that stay by themselves don't pass an exchange of texts."""
    df = spark.createDataFrame([(k, f"{k} " * 9, k) for k in range(50)] + [(60, X, 1), (61, X, 2)], "doc_id int, text string, n long")
    got = keep_one(df)
    assert sorted(r.doc_id for r in got.collect()) == [*range(50), 60]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    union = plan.split("\n")[0]
    assert union.startswith("Union") and plan.split("\n")[1].lstrip(":+- ").startswith("Filter")
