import pytest

import __spark_entry__ as contract
from catalogue import REGISTRY
from check_oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(contract.queries()) and set(REGISTRY) <= set(contract.oracle_sql())


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "order_key" in df.columns


@pytest.mark.parametrize("name", REGISTRY)
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert difference(df, con, contract.oracle_sql()[name]) is None
