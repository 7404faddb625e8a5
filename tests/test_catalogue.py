import pytest

import __spark_entry__ as entry
from lodestone.plans import catalogue, catalogue_ask, catalogue_more  # noqa: F401
from tests.oracle import compare

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
