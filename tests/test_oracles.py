"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from workload import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert name in oracle_sql()
    result = compare(spark, duck, name, queries()[name], oracle_sql()[name], SF_DIR)
    assert result.startswith("ok"), result


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["source", "field", "value", "n_violations"]
    assert df.count() > 0
