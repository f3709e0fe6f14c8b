"""Every registered core query against its SQL on the smallest tables."""

import pytest

from sluice.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[:2] == ["list", "position"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plan_has_no_product_of_tables(spark, sf_dir):
    plan = QUERIES["group_bands"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan
