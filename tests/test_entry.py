import pytest

import __spark_entry__ as entry
from compare import duck, rows_of
from echofold.plans import registry


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in registry.ORACLES:
        cur = duck(sf).execute(registry.ORACLES[name])
        assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
    else:
        assert got
