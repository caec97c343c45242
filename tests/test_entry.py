import __spark_entry__ as entry


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 30


def test_binders_of_names_of_any_length(spark, tmp_path):
    import duckdb
    from sigloom.plans import oracle, queries
    names = ["ring", "small ring", "ring big ring", "a b c a d", "very small old red ring"]
    spark.createDataFrame([(i, n, "B", "T", 1, 1.0) for i, n in enumerate(names)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(r) for r in queries.rename_binders(spark, str(tmp_path)).select("p_partkey", "renamed").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    assert got == set(con.execute(oracle.ORACLE["rename_binders"]).fetchall())
    assert (3, "{ @0 : T } { @1 : T } { @2 : T } { @0 : T } { @3 : T } -> @3") in got
