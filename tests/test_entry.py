import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "wide_profile" in queries
    assert all(callable(q) for q in queries.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "identity_id" and df.count() == df.select("identity_id").distinct().count() > 0
