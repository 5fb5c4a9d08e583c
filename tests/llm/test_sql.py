import pytest

from palimpsest.llm.queries import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert same(QUERIES[name](spark, "/root/testdata/sf0.01"), SQL[name], "/root/testdata/sf0.01") > 0
