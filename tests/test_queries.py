"""Every registered query against its SQL in another engine, on whole tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf_dir, name):
    ok, message = compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.write.format("noop").mode("overwrite").save()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
