"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite.checking import differences, open_tables

FOLDER = entry.SMOKE_DIR
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        assert differences(df, got, db.execute(ORACLES[name])) is None
    else:
        assert got


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
