import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["target", "neighbor", "cosine"]
    assert rows.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(entry.core_queries()) == set(entry.core_sql())


@pytest.mark.parametrize("name", sorted(entry.core_queries()))
def test_query_equals_sql(spark, con, name):
    rows = entry.core_queries()[name](spark, SF).toPandas()
    if name in entry.core_sql():
        assert difference(rows, con.sql(entry.core_sql()[name]).df()) is None
