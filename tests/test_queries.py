"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry

from oracle import connect, rows_of_duck, rows_of_spark
from shardloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = rows_of_spark(catalogue.QUERIES[name](spark, sf_dir))
    assert name in catalogue.ORACLE_SQL
    assert got == rows_of_duck(duck, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
