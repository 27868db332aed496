from collections import Counter

import pytest

import corpus_pipeline as cp
from gridfold.llm.line_dedup import dedup_lines
from gridfold.llm.quality import score_documents
from gridfold.llm.queries import QUERIES
from gridfold.llm.simhash_dedup import dedup_documents
from gridfold.session import stage

SF = "/root/testdata/sf0.001"


def test_each_stage_acts_on_all_that_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, ids = docs.schema.names, lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    good = cp.quality_classifier(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(good) == ids(score_documents(docs, labels).where("predicted = 1"))
    good = stage(spark, good, "t")
    lines = stage(spark, cp.line_dedup(spark, good, SF), "t")
    assert {(r.doc_id, r.text, r.n_chars) for r in lines.collect()} == {(r.doc_id, r.text, len(r.text)) for r in dedup_lines(good).collect()}
    one = stage(spark, cp.simhash_near_dedup(spark, lines, SF), "t")
    assert ids(one) == ids(dedup_documents(lines).where("kept"))
    clean = stage(spark, cp.secret_scans(spark, one, SF), "t")
    assert ids(clean) == ids(one)
    assert all(df.schema.names == names for df in (good, lines, one, clean))
    packed = cp.best_fit_packing(spark, clean, SF)
    assert set(ids(packed)) == set(ids(clean))
    assert cp.run(spark, SF).count() == packed.count()
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "secret_scans", "best_fit_packing"]


def test_stages_on_odd_and_empty_tables(spark, docs, empty):
    for table in (docs, empty):
        kept = table
        for _, f in cp.STAGES:
            kept = stage(spark, f(spark, kept, SF), "t")
            assert kept.count() >= 0


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))


@pytest.mark.parametrize("name", ["op1_embedding_graph", "op7_line_dedup", "op10_rendezvous_shards"])
def test_queries_return_a_row_for_each_input_row(spark, name):
    table = "embeddings" if name.startswith("op1_") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
