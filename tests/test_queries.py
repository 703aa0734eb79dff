import os

import pytest

from polyspark.plans.catalog import ORACLE_SQL, QUERIES

from .compare import rows_of, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = spark_rows(QUERIES[name](spark, SF))
    want = sql_rows(ORACLE_SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
