import numpy as np
from pyspark.sql import functions as F

from gridfold.llm import embed_dedup as E


def blob(n=600, noise=0.11, dim=16, seed=6):
    """One source whose rows link to some of it only, over many centres."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=dim) + noise * 6 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_a_verified_pair_counts_for_both_ends(spark):
    x = blob()
    linked = x @ x.T >= 0.9
    got = {r.vec_id: r for r in E.dedup_vectors(frame(spark, x), probes=1, recall=0.0, shard=40).collect()}
    others = {}
    for r in got.values():
        others.setdefault(r.component_id, []).append(r.vec_id)
    assert sum(r.n_links for r in got.values()) % 2 == 0
    for r in got.values():
        assert r.n_links <= linked[r.vec_id].sum() - 1
        assert (r.n_links > 0) == (len(others[r.component_id]) > 1)


def test_the_search_goes_on_where_edges_leave_the_probed_shards(spark):
    x = blob(3000, seed=8)
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in E.dedup_vectors(frame(spark, x), recall=0.0, shard=40).collect()}
    share = [got[i] / n for i, n in enumerate(true) if n]
    assert max(s for s in share) <= 1 and np.mean(share) > 0.9


def test_rows_that_stay_short_with_all_shards_probed_are_scanned(spark, monkeypatch):
    rng = np.random.default_rng(9)
    dense = rng.normal(size=16) + 0.1 * rng.normal(size=(150, 16))
    far = rng.normal(size=(300, 16))
    x = np.concatenate([dense, far, far[:40] + 0.02 * rng.normal(size=(40, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    no_edges = F.array().cast("array<long>").alias("out")
    monkeypatch.setattr(E, "_build", lambda index: index.select("vec_id").distinct().select("vec_id", no_edges))
    got = {r.vec_id: r for r in E.dedup_vectors(frame(spark, x), shard=64).collect()}
    assert [got[i].n_links for i in range(len(x))] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()
    assert all(r.recall == 1 for r in got.values())


def test_small_groups_are_judged_by_themselves():
    dense, pairs = [(1000, 1000, 1.0)] * 70, [(1, 0, 3.0)] * 40
    assert E.judge(dense + pairs, 0.98) == (0.0, 1)
    assert E.judge(dense, 0.98) == (1.0, None) and E.judge([], 0.98) == (1.0, None)


def test_rows_that_share_a_vec_id_are_vectors_of_their_own(spark):
    rows = [(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (9, [1.0, 0.05]), (4, [-1.0, 0.0]), (None, [1.0, 0.0]), (5, None), (5, [0.0, 0.0])]
    got = E.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = [(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (2, 2, 1, False), (9, 1, 1, False), (4, 0, 4, True), (None, 0, None, True), (5, 0, 5, True), (5, 0, 5, True)]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted(want, key=key)


def test_recall_is_null_where_no_audited_row_has_a_link(spark):
    got = E.dedup_vectors(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<double>"))
    assert [r.recall for r in got.collect()] == [None] * 3


def test_the_sql_gives_the_same_rows(spark):
    import duckdb
    import pyarrow as pa

    x = blob(120, dim=8)
    rows = [(i % 110, v.tolist()) for i, v in enumerate(x)] + [(200, x[0].tolist()), (None, x[1].tolist()), (201, None), (202, []), (203, [0.0] * 8),
                                                              (204, [None] + [1.0] * 7), (205, [float("nan")] * 8), (206, [1.0, 0.0]), (207, [0.0, 1.0])]
    got = E.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    db = duckdb.connect()
    db.register("embeddings", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    want = db.sql(E.link_sql()).fetchall()
    assert sum(r[1] for r in want) > 100
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
