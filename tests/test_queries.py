"""Every registered query at the smallest scale, whole result against its SQL."""

import pytest
from oracle import compare, duck

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    msg, ok = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert ok is not False, msg


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"entity", "outcome", "confidence", "rank"}
    assert df.count() > 0
