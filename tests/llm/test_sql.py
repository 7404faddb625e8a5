import pytest

from lodestone.llm import queries
from tests.oracle import compare

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], SQL[name])


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.queries())
    assert numbers == list(range(1, 14))
