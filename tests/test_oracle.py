"""Every query of the reference's operators against its SQL."""

import math

import pytest

from factorloom import catalog

from .oracle import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, data, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, data)) == duck_rows(duck, catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, data, name):
    rows = catalog.QUERIES[name](spark, data).collect()
    again = catalog.QUERIES[name](spark, data).collect()
    assert rows and sorted(map(str, rows)) == sorted(map(str, again))
    assert all(v is None or not isinstance(v, float) or math.isfinite(v) for r in rows for v in r)
