"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from batchloom.catalog import registry
from tests.conftest import SMALL

QUERIES = {name: run for name, run in entry.queries().items() if name in registry.QUERIES}
ORACLES = registry.ORACLES


def rows_of(table):
    names = sorted(table.column_names)
    return sorted(tuple(map(repr, r)) for r in zip(*[table.column(n).to_pylist() for n in names]))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toArrow()
    want = duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_gives_known_counts(spark):
    row = entry.entry(spark).first()
    assert (row.TOTAL, row.RUNNING, row.FAILED, row.VERIFIED_OK, row.VERIFIED_FAILED) == (14, 3, 2, 5, 2)
    assert row.SUCCEEDED == 7
