"""What the store keeps beside its rows, and the newest landings."""

import datetime as dt

import pytest
from fixtures import worked_rows, write_book
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.operators.checks import CheckFailure, RowCheck
from gridfold.operators.lineage import latest_landing
from gridfold.operators.report import period_summary, stored_batches, stored_period_summary
from gridfold.plans.ledger_ingest import check_stored, ledger_ingest
from gridfold.sources.latest import LatestLandings, lineage_log
from gridfold.sources.store import FactStore

SCHEMA = T.StructType([T.StructField(n, t()) for n, t in (
    ("batch_key", T.StringType), ("source_file", T.StringType), ("period_type", T.StringType), ("year", T.IntegerType),
    ("is_estimate", T.BooleanType), ("value", T.DoubleType))])


def _facts(spark, batches):
    rows = [(k, f, p, 2020 + i % 3, i % 2 == 0, float(i)) for k, f, n in batches for i in range(n) for p in ("Q", "FY")]
    return spark.createDataFrame(rows, SCHEMA)


def _keys(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "batch_key string")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _agrees(st):
    assert [tuple(r) for r in stored_period_summary(st.summary()).collect()] == [tuple(r) for r in period_summary(st.read()).collect()]
    assert _rows(stored_batches(st.summary())) == _rows(st.read().groupBy("batch_key", "source_file").count())


def test_kept_counts_equal_the_full_aggregate(spark, tmp_path):
    st = FactStore(spark, f"file://{tmp_path}/store", SCHEMA, buckets=4)
    _agrees(st)  # empty
    first = [(f"b{i}", f"f{i % 3}.xlsx", i + 1) for i in range(9)] + [(None, None, 2)]
    st.replace(_facts(spark, first), _keys(spark, *[k for k, _, _ in first]))
    _agrees(st)
    for _ in range(2):  # delivered again, one batch emptied
        assert st.replace(_facts(spark, [("b1", "g.xlsx", 5)]), _keys(spark, "b1", "b2")) == 10
        _agrees(st)
    st.remove(_keys(spark, "b3", None))
    _agrees(st)
    assert sum(st.snapshot().rows.values()) == st.read().count()
    assert st.summary(version=1).agg(F.sum("row_count")).first()[0] == 2 * (45 + 2)  # earlier versions keep theirs
    st.expire(keep=1)
    _agrees(st)
    st.remove(st.read().select("batch_key"))
    _agrees(st)


def test_reports_read_no_facts(spark, tmp_path):
    st = FactStore(spark, f"file://{tmp_path}/store", SCHEMA, buckets=4)
    st.replace(_facts(spark, [("a", "f.xlsx", 3)]), _keys(spark, "a"))
    assert all("/summary/" in f for f in stored_period_summary(st.summary()).inputFiles())


def test_a_file_is_read_from_its_buckets_only(spark, tmp_path):
    st = FactStore(spark, f"file://{tmp_path}/store", SCHEMA, buckets=64)
    every = [(f"b{i}", f"f{i}.xlsx", 2) for i in range(60)] + [("more", "f7.xlsx", 1)]
    st.replace(_facts(spark, every), _keys(spark, *[k for k, _, _ in every]))
    one = st.read(files=["f7.xlsx"])
    want = {r[0] for r in _keys(spark, "b7", "more").select(st.bucket_of()).collect()}
    assert {int(f.split("/bucket=")[1].split("/")[0]) for f in one.inputFiles()} == want
    assert _rows(one) == _rows(st.read().where("source_file = 'f7.xlsx'")) and one.count() == 6
    assert _rows(st.read(keys=["more"], files=["f7.xlsx"]).select("batch_key").distinct()) == [("more",)]
    assert st.read(files=["none.xlsx"]).count() == 0
    # a store that does not count by file still answers, from all buckets
    plain = FactStore(spark, f"file://{tmp_path}/plain", SCHEMA, buckets=4, summary=())
    plain.replace(_facts(spark, every), _keys(spark, *[k for k, _, _ in every]))
    assert plain.read(files=["f7.xlsx"]).count() == 6
    with pytest.raises(KeyError):
        FactStore(spark, f"file://{tmp_path}/bad", SCHEMA, summary=("nope",))


def test_one_file_is_checked_as_a_step(spark, tmp_path):
    st = FactStore(spark, f"file://{tmp_path}/store", SCHEMA, buckets=8)
    st.replace(_facts(spark, [("BLB_260101", "good.xlsx", 3), ("BLB_260102", "big.xlsx", 9)]), _keys(spark, "BLB_260101", "BLB_260102"))
    small = [RowCheck("small", "value < 5")]
    assert check_stored(st, "good.xlsx", small) == 6
    with pytest.raises(CheckFailure, match="big.xlsx"):
        check_stored(st, "big.xlsx", small)
    with pytest.raises(CheckFailure, match="no rows"):
        check_stored(st, "none.xlsx", small)


# ----------------------------------------------------------------- landings
LOG = "file_name string, uploaded_by string, uploaded_at timestamp"


def _log(spark, rows):
    return spark.createDataFrame([(n, u, None if t is None else dt.datetime(2026, 1, 1) + dt.timedelta(hours=t)) for n, u, t in rows], LOG)


def test_latest_landings_equal_the_whole_log(spark, tmp_path):
    rows = [(f"f{i % 7}.xlsx", f"u{i % 5}", i % 11) for i in range(60)] + [("n.xlsx", None, None), ("n.xlsx", "u", None), (None, "x", 3), (None, None, 4)]
    latest = LatestLandings(spark, f"file://{tmp_path}/latest", buckets=4)
    for part in (rows[40:], rows[:20], rows[20:40], rows[20:40], []):  # out of order, one part twice, none
        latest.add(_log(spark, part))
    assert _rows(latest.read()) == _rows(latest_landing(_log(spark, rows)))


def test_two_writers_of_landings_both_count(spark, tmp_path, monkeypatch):
    latest = LatestLandings(spark, f"file://{tmp_path}/latest", buckets=1)
    other, commit = LatestLandings(spark, f"file://{tmp_path}/latest"), FactStore._commit

    def late(self, snapshot):
        monkeypatch.setattr(FactStore, "_commit", commit)
        other.add(_log(spark, [("a", "late", 9), ("b", "late", 1)]))
        return commit(self, snapshot)

    latest.add(_log(spark, [("a", "u", 0)]))
    monkeypatch.setattr(FactStore, "_commit", late)
    latest.add(_log(spark, [("a", "v", 5), ("c", "v", 5)]))
    assert [r[:2] for r in _rows(latest.read())] == [("a", "late"), ("b", "late"), ("c", "v")]


def test_a_log_that_cannot_be_read_is_a_warning(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    write_book(land / "a.xlsx", "BLB_260101", worked_rows())
    names = spark.createDataFrame([("a.xlsx",)], "source_file string")
    good = _log(spark, [("a.xlsx", "old", 1), ("a.xlsx", "new", 2), ("z.xlsx", "z", 3)])
    log, why = lineage_log(spark, good, names)
    assert why is None and [r[:2] for r in _rows(log)] == [("a.xlsx", "new")]
    assert lineage_log(spark, None, names) == (None, None)
    broken = tmp_path / "log"
    broken.mkdir()
    (broken / "part.parquet").write_bytes(b"PAR1 torn")
    for n, log in enumerate([lambda: spark.table("no_such_log"), lambda: spark.read.schema(LOG).parquet(f"file://{broken}"), good.drop("uploaded_at")]):
        st = FactStore(spark, f"file://{tmp_path}/facts{n}", buckets=2)
        run = ledger_ingest(spark, str(land), st, log=log)
        assert run.warning.startswith("landing log not read: ") and run.rows_written == 11
        assert st.read().where("upload_user IS NULL AND upload_datetime IS NULL").count() == 11
    st = FactStore(spark, f"file://{tmp_path}/known", buckets=2)
    run = ledger_ingest(spark, str(land), st, log=good)
    assert run.warning is None and st.read().where("upload_user = 'new'").count() == 11
