import pytest
from compare import oracle, rows

from tickloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    got, want = QUERIES[name](spark, SF).toPandas(), oracle(SF, SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
