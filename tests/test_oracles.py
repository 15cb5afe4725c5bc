"""Every registered query agrees with its SQL at the smallest scale."""

import oracle
import pytest
from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, sf, name):
    fn = queries()[name]
    if name in oracle_sql():
        assert oracle.difference(spark, con, name, fn, oracle_sql()[name], sf) is None
    else:
        assert fn(spark, sf).count() > 0
