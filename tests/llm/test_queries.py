"""The queries that SQL can express, against it, on the smallest dataset."""

import pytest

from plumbline.llm.queries import QUERIES, SQL
from tests.test_queries import compare, duck, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, QUERIES[name], SQL[name])
