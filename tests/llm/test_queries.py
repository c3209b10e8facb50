"""Queries of the subpackage against their SQL on the smallest tables."""

import pytest

from marlstone.llm.registry import ORACLE_SQL, QUERIES
from tests.test_plans import duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, small, duck, name):  # noqa: F811
    got = QUERIES[name](spark, small).toPandas()
    want = duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)
