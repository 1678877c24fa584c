import pytest

from scriptorium.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001") > 0
