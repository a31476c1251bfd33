import pytest

from marlstone.llm import queries
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, sf, con, name):
    oracle.assert_matches(spark, sf, con, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE.keys() - {"p9_found"}))
def test_query_without_sql_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_p9_columns(spark, sf):
    assert queries.QUERIES["p9_found"](spark, sf).columns == ["doc_id", "category"]
