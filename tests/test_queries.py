"""Each registered query of the library against its SQL in DuckDB, and the entry."""

import pytest

import __spark_entry__
from compare import difference, oracle
from timbral.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        assert not difference(df, con, sql)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
