import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.check import difference, duck
from workload.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_entry(spark):
    row = entry(spark).first()
    assert row["nnz"] == 6000 and row["rmse"] > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    got = queries()[name](spark, SMALL).toPandas()
    assert difference(got, duck(SMALL).execute(oracle_sql()[name]).df()) is None
