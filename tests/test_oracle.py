"""Every query with a SQL twin gives the same rows as the twin; the others run."""

import pytest
from oracle_check import compare, connect

from finegrid.plans.catalog import all_queries

SF = "/root/testdata/sf0.001"
SLOW = {"group_cv", "leave_parent_out", "space_select", "exceedance_isotonic", "quantile_conformal"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in all_queries() if n not in SLOW])
def test_query(spark, con, name):
    diff, rows, _ = compare(spark, con, all_queries()[name], SF)
    assert diff == ""
    assert rows >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
