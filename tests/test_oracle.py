import pytest

from checks.catalog import QUERIES
from checks.compare import connect, difference
from checks.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, name):
    assert difference(QUERIES[name](spark, SF), db, ORACLE[name]) is None


@pytest.mark.parametrize("wrong", ["x + 1 AS x", "x::VARCHAR AS x", "x AS y", "nullif(x, 3) AS x"])
def test_comparison_notices(spark, db, wrong):
    df = spark.range(5).withColumnRenamed("id", "x")
    assert difference(df, db, "SELECT x FROM range(5) t(x)") is None
    assert difference(df, db, f"SELECT {wrong} FROM range(5) t(x)") is not None


def test_entry(spark):
    import __spark_entry__ as contract

    rows = contract.entry(spark).collect()
    assert rows and sum(r.original for r in rows) == 200
    assert contract.queries().keys() >= contract.oracle_sql().keys()
