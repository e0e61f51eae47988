"""Every core query with a SQL equivalent gives the same rows on the smallest tables."""

import pytest
from conftest import DATA, rows_of

from factloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    found = duck.execute(registry.ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(found.fetchall(), columns)


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
