import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridfold.llm import secret_scan as S
from gridfold.llm.quality import FEATURES, features, fit_gam, keep_documents, score_documents
from gridfold.llm.sharding import shard_documents

SF = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    for t in ("", "  \n", "one", "||| |", "x" * 10_000, "é" * 5):
        f = features(t)
        assert len(f) == len(FEATURES) and np.isfinite(f).all()


def test_gam_learns_single_features_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 0.8)).astype(float)
    m = fit_gam(x[:3000], y[:3000], rounds=60, pair_rounds=80)
    assert (0, 1) in m.pairs
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    only = fit_gam(x[:50], np.ones(50))
    assert (only.score(x[:5]) > 0.9).all()
    assert fit_gam(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_quality_held_out_accuracy_and_flags(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = score_documents(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    held = out[out["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9


def test_quality_edges(docs, rows, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = score_documents(docs, none).collect()
    assert len(out) == len(rows) and all(r.score == 0.5 for r in out)
    marks = spark.createDataFrame([(3, 1), (3, None), (6, 0), (None, 1), (999, 1)], "doc_id long, quality int")
    assert score_documents(docs, marks).count() == len(rows)
    assert score_documents(empty, marks).count() == 0
    kept = keep_documents(docs, none)
    assert kept.schema == docs.schema and kept.count() == len(rows)


def test_forest_on_held_out_findings():
    words = {w: 5 for w in "thention erandle whole neither above mention orbit season little planet".split()}
    reader, forest = S.train(words, S.labelled_findings(sorted(words), 2000, seed=1))
    held = S.labelled_findings(sorted(words), 600, seed=2)
    p = forest.score(np.array([reader.features(t, a, b) for t, a, b, _ in held]))
    assert ((p >= 0.5) == np.array([s for *_, s in held])).mean() > 0.95


def test_scan_finds_the_planted_secrets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    true = re.compile(r'(?i)(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}|AKIA[A-Z0-9]{16}')
    want = {r.doc_id: ",".join(f"{m.start()}-{m.end()}" for m in true.finditer(r.text or "")) for r in docs.collect()}
    got = {r.doc_id: r.spans for r in S.scan_documents(docs).collect()}
    assert got == want
    red = {r.doc_id: r for r in S.redact_documents(docs).collect()}
    for r in docs.collect():
        assert red[r.doc_id].text == true.sub(S.REDACTED, r.text or "") and red[r.doc_id].n_chars == len(red[r.doc_id].text)


def test_scan_edges(docs, rows, empty):
    assert S.scan_documents(docs).count() == len(rows) and S.scan_documents(empty).count() == 0
    out = S.redact_documents(docs)
    assert out.schema == docs.schema
    was, now = Counter(r[:2] for r in rows if "token" not in (r[1] or "")), Counter((r.doc_id, r.text) for r in out.collect())
    assert not was - now and sum(now.values()) == len(rows)


def test_shards(docs, rows, empty):
    out = shard_documents(docs).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert all(r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8) for r in out)
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in out}) == len({r.doc_id for r in out})
    assert shard_documents(empty).count() == 0


def test_shards_follow_the_weights(spark):
    many = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    n = Counter(r.shard for r in shard_documents(many, weights=(1.0, 2.0, 1.0)).collect())
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    before = {r.doc_id: r.shard for r in shard_documents(many, weights=(1.0, 1.0)).collect()}
    after = {r.doc_id: r.shard for r in shard_documents(many, weights=(1.0, 1.5)).collect()}
    assert all(after[i] == 1 for i in before if before[i] != after[i])
    with pytest.raises(ValueError):
        shard_documents(many, weights=(1.0, 0.0))
