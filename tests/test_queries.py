"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from run_queries import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert compare(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "doc_id", "used", "kept"]
    assert df.filter("octet_length(kept) <> used or used > 600").count() == 0
    assert df.count() > 0
