"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.conftest import SF, rows_of
from tidemark.plans import catalog


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, duck):
    got = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        got = got.toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
    else:
        assert got.count() > 0


def test_flagship_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
