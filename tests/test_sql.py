import pytest

import palimpsest.plans.trees  # noqa: F401  adds its queries
from palimpsest.plans.registry import QUERIES, SQL
from tests.oracle import same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert same(QUERIES[name](spark, SF), SQL[name], SF) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
