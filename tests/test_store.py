"""M1/M2: the bucketed store, its commits, and the ingest ledger."""

import os
import uuid

import pytest
from fixtures import worked_rows, write_book
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.operators.ledger import LEDGER_SCHEMA, latest_entries
from gridfold.plans.ingest import IngestError
from gridfold.plans.ledger_ingest import ledger_ingest, remove_from_store
from gridfold.schema import FACT_COLUMNS
from gridfold.sources import store as S
from gridfold.sources.store import FactStore, StoreConflict

SCHEMA = T.StructType([T.StructField("batch_key", T.StringType()), T.StructField("n", T.IntegerType())])


def _store(spark, tmp_path, buckets=4):
    return FactStore(spark, f"file://{tmp_path}/store", SCHEMA, buckets=buckets)


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _keys(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "batch_key string")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_replace_empty_remove_and_read_back(spark, tmp_path):
    st = _store(spark, tmp_path)
    assert _rows(st.read()) == []
    first = [(k, i) for i, k in enumerate(["a", "b", "c", "d", "e", None, "a"])]
    assert st.replace(_df(spark, first), _keys(spark, "a", "b", "c", "d", "e", None)) == 7
    assert _rows(st.read()) == sorted(first, key=repr)
    for _ in range(2):  # a repeated delivery leaves the same rows
        assert st.replace(_df(spark, [("a", 10), ("c", 11)]), _keys(spark, "a", "c", "e")) == 2
        want = [("a", 10), ("b", 1), ("c", 11), ("d", 3), (None, 5)]
        assert _rows(st.read()) == sorted(want, key=repr)
    st.remove(_keys(spark, None, "b", "not there"))
    assert _rows(st.read()) == [("a", 10), ("c", 11), ("d", 3)]
    assert _rows(st.read(keys=["a", "b", None])) == [("a", 10)]
    assert _rows(st.read(version=1)) == sorted(first, key=repr)  # earlier versions stay whole
    assert sum(st.snapshot().rows.values()) == 3
    with pytest.raises(ValueError, match="not named"):
        st.replace(_df(spark, [("zz", 1), ("y", 1), ("x", 1), ("w", 2), ("v", 3)]), _keys(spark, "a"))
    assert _rows(FactStore(spark, st.root).read()) == [("a", 10), ("c", 11), ("d", 3)]


def test_only_touched_buckets_are_written(spark, tmp_path):
    st = _store(spark, tmp_path, buckets=64)
    keys = [f"k{i}" for i in range(200)]
    st.replace(_df(spark, [(k, 1) for k in keys]), _keys(spark, *keys))
    before = st.snapshot()
    st.replace(_df(spark, [("k7", 2)]), _keys(spark, "k7"))
    after = st.snapshot()
    assert sum(after.folders[b] != before.folders[b] for b in after.folders) == 1
    # a read by key opens that bucket's files only
    assert {f.split("/bucket=")[1].split("/")[0] for f in st.read(keys=["k7"]).inputFiles()} == {
        str(spark.createDataFrame([("k7",)], "batch_key string").select(st.bucket_of()).first()[0])}
    assert _rows(st.read(keys=["k7"])) == [("k7", 2)]


def test_a_run_killed_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    st = _store(spark, tmp_path)
    st.replace(_df(spark, [("a", 1), ("b", 2)]), _keys(spark, "a", "b"))

    def killed(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(FactStore, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            st.replace(_df(spark, [("a", 9)]), _keys(spark, "a", "b"))
    assert len(os.listdir(tmp_path / "store/data")) == 2  # written, never committed
    assert _rows(FactStore(spark, st.root).read()) == [("a", 1), ("b", 2)]
    st.replace(_df(spark, [("a", 9)]), _keys(spark, "a"))
    assert _rows(st.read()) == [("a", 9), ("b", 2)]
    st.expire(keep=1)
    assert _rows(st.read()) == [("a", 9), ("b", 2)]
    assert len(os.listdir(tmp_path / "store/snapshots")) <= 2  # one and its checksum


def test_two_writers(spark, tmp_path, monkeypatch):
    st = _store(spark, tmp_path, buckets=64)
    st.replace(_df(spark, [("a", 1), ("b", 2)]), _keys(spark, "a", "b"))
    other = FactStore(spark, st.root)
    commit = FactStore._commit

    def meanwhile(key, n):
        def late(self, snapshot):
            monkeypatch.setattr(FactStore, "_commit", commit)
            other.replace(_df(spark, [(key, n)]), _keys(spark, key))
            return commit(self, snapshot)

        monkeypatch.setattr(FactStore, "_commit", late)

    meanwhile("b", 20)  # another batch's bucket: both writes hold
    st.replace(_df(spark, [("a", 10)]), _keys(spark, "a"))
    assert _rows(st.read()) == [("a", 10), ("b", 20)]
    meanwhile("a", 30)  # the same batch: the second writer is told
    with pytest.raises(StoreConflict):
        st.replace(_df(spark, [("a", 11)]), _keys(spark, "a"))
    assert _rows(st.read()) == [("a", 30), ("b", 20)]


# ------------------------------------------------------------------- ledger
def _book(root, name, sheet, scale=1, at=0, rows=None):
    rows = rows or worked_rows()
    rows[7] = {c: (str(float(t) * scale) if c > 2 and t.replace(".", "").isdigit() else t) for c, t in rows[7].items()}
    p = write_book(root / name, sheet, rows)
    os.utime(p, (1_700_000_000 + at, 1_700_000_000 + at))
    return p


def _state(st):
    return {r["source_file"]: (r["outcome"], r["batch_key"], r["row_count"]) for r in latest_entries(st.ledger(LEDGER_SCHEMA)).collect()}


def _batches(st):
    return {r["batch_key"]: r["source_file"] for r in st.read().select("batch_key", "source_file").distinct().collect()}


def test_removed_batches_stay_removed(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    st = FactStore(spark, f"file://{tmp_path}/facts", buckets=8)
    _book(land, "a1.xlsx", "BLB_260101", 1, 0)
    _book(land, "a2.xlsx", "BLB_260101", 2, 60)
    _book(land, "b.xlsx", "BLB_260102", 3, 120)
    run = ledger_ingest(spark, str(land), st)
    assert (run.taken, run.rows_written) == (3, 22)
    assert _batches(st) == {"BLB_260101": "a2.xlsx", "BLB_260102": "b.xlsx"}
    assert _state(st) == {"a1.xlsx": ("superseded", "BLB_260101", 11), "a2.xlsx": ("landed", "BLB_260101", 11), "b.xlsx": ("landed", "BLB_260102", 11)}
    assert ledger_ingest(spark, str(land), st).taken == 0  # nothing new: no file is read

    remove_from_store(st, spark.createDataFrame([("BLB_260101",)], "batch_key string"))
    assert _batches(st) == {"BLB_260102": "b.xlsx"}
    assert ledger_ingest(spark, str(land), st).taken == 0
    os.utime(land / "a1.xlsx", (1_800_000_000, 1_800_000_000))  # a new time, the same bytes
    assert ledger_ingest(spark, str(land), st).taken == 0
    assert _batches(st) == {"BLB_260102": "b.xlsx"} and _state(st)["a1.xlsx"][0] == "removed"

    assert ledger_ingest(spark, str(land), st, reprocess=True, names=["a2.xlsx"]).taken == 1
    assert _batches(st) == {"BLB_260101": "a2.xlsx", "BLB_260102": "b.xlsx"}
    # a file that arrives later wins its batch, though its time is older
    _book(land, "late.xlsx", "BLB_260102", 7, -600)
    assert ledger_ingest(spark, str(land), st).taken == 1
    assert _batches(st)["BLB_260102"] == "late.xlsx"


def test_failures_are_noted_and_tried_again(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    st = FactStore(spark, f"file://{tmp_path}/facts", buckets=8)
    bad = {r: ({c: t for c, t in cs.items() if c != 2} if r == 4 else cs) for r, cs in worked_rows().items()}
    _book(land, "good.xlsx", "BLB_260101")
    _book(land, "bad.xlsx", "BLB_260103", rows=bad)
    (land / "torn.xlsx").write_bytes(b"PK not a zip")
    with pytest.raises(IngestError, match="2 of 3"):
        ledger_ingest(spark, str(land), st)
    state = _state(st)
    assert state["good.xlsx"][0] == "landed" and state["bad.xlsx"][0] == state["torn.xlsx"][0] == "failed"
    assert all(r["error"] for r in st.ledger(LEDGER_SCHEMA).where("outcome = 'failed'").collect())
    assert ledger_ingest(spark, str(land), st, raise_on_error=False).taken == 2
    _book(land, "torn.xlsx", "BLB_260104", 2, 60)
    (land / "bad.xlsx").unlink()
    assert ledger_ingest(spark, str(land), st).taken == 1
    assert sorted(_batches(st)) == ["BLB_260101", "BLB_260104"]
    assert st.read().columns == FACT_COLUMNS and st.read(keys=["BLB_260104"]).count() == 11


def test_ledger_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "LEDGER_FOLDERS", 3)
    st = _store(spark, tmp_path)
    row = lambda n: spark.createDataFrame([(f"f{n}", "d", 1, None, "k", "landed", None, n, uuid.uuid4().hex, n)], LEDGER_SCHEMA)
    for n in range(7):
        st.note(row(n))
    assert len(st.snapshot().ledger) <= 3 and st.ledger(LEDGER_SCHEMA).count() == 7
    assert st.ledger(LEDGER_SCHEMA).agg(F.sum("row_count")).first()[0] == 21


# ------------------------------------------------------------------- stream
def _stream(spark, tmp_path, name, max_files, land, **kw):
    from gridfold.streaming.ledger_stream import ledger_stream

    st = FactStore(spark, f"file://{tmp_path}/{name}", buckets=8)
    q = ledger_stream(spark, str(land), st, str(tmp_path / f"{name}-ck"), max_files=max_files, **kw)
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001 - the caller asks the query
        pass
    return st, q


def test_stream_is_the_same_table_for_any_batch_size(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for i in range(7):
        _book(land, f"f{i}.xlsx", f"BLB_26010{1 + i % 3}", 1 + i, 60 * i)
    got = [_stream(spark, tmp_path, f"s{n}", n, land)[0] for n in (1, 4)]
    rows = [sorted(map(tuple, st.read().drop("upload_datetime", "upload_user").collect()), key=repr) for st in got]
    assert rows[0] == rows[1] and _batches(got[0]) == {"BLB_260101": "f6.xlsx", "BLB_260102": "f4.xlsx", "BLB_260103": "f5.xlsx"}


def test_a_replayed_micro_batch_leaves_one_copy(spark, tmp_path):
    from gridfold.operators.checks import RowCheck
    from gridfold.sources.workbook import list_binary
    from gridfold.streaming.ledger_stream import apply_micro_batch

    land = tmp_path / "land"
    land.mkdir()
    _book(land, "good.xlsx", "BLB_260101")
    (land / "torn.xlsx").write_bytes(b"no zip")
    st = FactStore(spark, f"file://{tmp_path}/facts", buckets=8)
    q = str(tmp_path / "q")
    for _ in range(3):
        apply_micro_batch(st, list_binary(spark, str(land)), "query-0", str(tmp_path / "stage0"), checks=[RowCheck("small", "value < 1")], quarantine=q)
    entries = [(r["source_file"], r["outcome"]) for r in st.ledger(LEDGER_SCHEMA).collect()]
    assert sorted(entries) == [("good.xlsx", "landed"), ("torn.xlsx", "failed")]
    assert [(r["check"], r["source_file"], r["run_id"]) for r in spark.read.parquet(q).collect()] == [("small", "good.xlsx", "query-0")]


def test_a_stream_told_to_fail_fails_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "torn.xlsx").write_bytes(b"no zip")
    os.utime(land / "torn.xlsx", (1_600_000_000, 1_600_000_000))
    _book(land, "good.xlsx", "BLB_260101")
    st, q = _stream(spark, tmp_path, "s", 1, land, raise_on_error=True)
    assert q.exception() is not None and _batches(st) == {}
    st, q = _stream(spark, tmp_path, "s", 1, land, raise_on_error=True)
    assert q.exception() is None and _batches(st) == {"BLB_260101": "good.xlsx"}
    assert _state(st)["torn.xlsx"][0] == "failed" and st.ledger(LEDGER_SCHEMA).count() == 2
