"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, small, duck, name):
    table = QUERIES[name](spark, small).toArrow()
    assert table.num_rows > 0
    if name in SQL:
        assert difference(table, duck.execute(SQL[name]).to_arrow_table()) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
