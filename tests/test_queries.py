"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert difference(con, SQL[name], df) is None
    else:
        assert df.collect()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "score"]
