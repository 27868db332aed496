import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["period_type", "year", "is_estimate", "row_count"]
    assert len(rows) > 0


def test_every_query_has_an_oracle():
    from gridfold.plans.oracles import ORACLES
    from gridfold.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_small_queries_match_oracles_at_smoke_scale(spark):
    import duckdb
    from tools.check_oracles import TABLES, digest

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ["long_facts", "header_classes", "key_check", "run_outcomes", "replace_batches", "unique_names"]:
        df = E.queries()[name](spark, sf)
        cur = con.execute(E.oracle_sql()[name])
        dcols = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(dcols), name
        assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(dcols, cur.fetchall())[0], name
