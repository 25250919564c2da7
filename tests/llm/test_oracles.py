"""Queries against their SQL on the smallest tables."""

import pytest

from batchloom.llm import queries
from tests.conftest import SMALL
from tests.test_queries import rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SMALL).toArrow()
    want = duck.sql(queries.ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)
