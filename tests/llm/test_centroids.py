import hashlib
import math

import pytest

from gridfold.llm.centroids import centroid_sql, cluster_vectors

COLS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [v for _, v in sorted(kept, key=name)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(col) for col in zip(*(v for (_, v), m in zip(kept, mine) if m == n))] or c for n, c in enumerate(cs)]
    last = [(i, *near(v)) for i, v in kept]
    each = {n: sum(d for _, d, m in last if m == n) for n in range(len(cs))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, m, d, each[m], sum(each.values()), sha[m]) for i, d, m in last), key=str)


def vectors(n, seed=3):
    import random

    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1, 0, 1, 2)) + rng.gauss(0, 0.3) for _ in range(64)]) for i in range(n)]
    bad = [(900, None), (901, [1.0] * 63), (902, [1.0] * 65), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63),
           (905, [float("inf")] + [0.0] * 63), (906, [])]
    return rows + bad + [(0, rows[1][1]), rows[2], rows[2], (None, rows[3][1]), (None, [0.0] * 64), (907, [-0.001] * 64)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, [0], 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, q array<int>, distance int").repartition(3)


@pytest.mark.parametrize("n", [0, 5, 120])
def test_against_brute_force(spark, n):
    rows = vectors(n) if n else [(1, None)]
    out = cluster_vectors(frame(spark, rows))
    assert out.columns == COLS
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)


def test_large_components_are_refused(spark):
    with pytest.raises(ValueError, match="at most"):
        cluster_vectors(frame(spark, [(1, [1e300] + [0.0] * 63)]))


def test_equals_the_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(f"SELECT {', '.join(COLS)} FROM ({centroid_sql()})").fetchall()
    assert sorted(tuple(r) for r in cluster_vectors(spark.read.parquet(path)).collect()) == sorted(want)
