import compare
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, folder, name):
    assert compare.compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    from mektup import oracles

    assert set(oracles.oracle_sql()) <= set(entry.queries())
