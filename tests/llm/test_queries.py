import pytest

from factorloom.llm import queries

from ..oracle import connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, data, name):
    assert spark_rows(queries.QUERIES[name](spark, data)) == duck_rows(connect(data), queries.ORACLE_SQL[name])


def test_one_query_an_operator():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 14))
