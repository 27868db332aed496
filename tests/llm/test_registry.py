"""Every query of the operators has SQL or a test that holds it against brute force."""


import pytest

TESTED = {
    "op1_embedding_graph": "tests.llm.test_embedding_links", "op2_fingerprints": "tests.llm.test_dedup", "op3_byte_bpe": "tests.llm.test_tokens",
    "op4_simhash_dedup": "tests.llm.test_dedup", "op5_token_counts": "tests.llm.test_tokens", "op6_secret_scan": "tests.llm.test_secret_candidates",
    "op7_line_dedup": "tests.llm.test_dedup", "op8_best_fit_packing": "tests.llm.test_tokens", "op9_quality": "tests.llm.test_quality_secrets_shards",
    "op10_rendezvous_shards": "tests.llm.test_quality_secrets_shards", "op12_token_alignment": "tests.llm.test_alignment", "op13_token_files": "tests.llm.test_token_files",
    "pipeline": "tests.llm.test_pipeline",
}


def test_each_query_has_sql_or_a_test():
    import __spark_entry__ as E
    from gridfold.plans.queries import QUERIES

    mine = set(E.queries()) - set(QUERIES)
    assert mine == set(TESTED) | set(E.oracle_sql()) & mine


@pytest.mark.parametrize("name", sorted(set(TESTED.values())))
def test_the_named_test_exists(name):
    import pathlib

    assert (pathlib.Path(__file__).parents[2] / (name.replace(".", "/") + ".py")).exists()
