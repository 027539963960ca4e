import pytest

import __spark_entry__ as entry
import oracle
from spendkit.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 5 and "utilization_pct" in rows.columns


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, entry.oracle_sql()[name]) == []
