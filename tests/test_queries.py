import pytest

import __spark_entry__ as entry
from marlstone.plans import core
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query_matches_its_sql(spark, sf, con, name):
    oracle.assert_matches(spark, sf, con, core.QUERIES[name], core.ORACLE[name])


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - core.ORACLE.keys()))
def test_query_without_sql_has_rows(spark, sf, name):
    assert core.QUERIES[name](spark, sf).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
