"""Every query of the library runs; those with SQL give what DuckDB gives."""

import pytest

from tests.parity import connect, same
from tracemill.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert len(set(map(str.lower, df.columns))) == len(df.columns)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
