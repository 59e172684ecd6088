import pytest
from oracle import DATA, compare, connect

from corvane.plans import all_queries, all_sql

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_like_sql(spark, con, name):
    compare(spark, con, all_queries()[name], all_sql()[name])


@pytest.mark.parametrize("name", sorted(all_queries().keys() - all_sql().keys()))
def test_runs(spark, name):
    assert all_queries()[name](spark, str(DATA)).columns
