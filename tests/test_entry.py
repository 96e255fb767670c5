import __spark_entry__ as entry


def test_contract(spark, data):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert entry.entry(spark).count() >= 0
