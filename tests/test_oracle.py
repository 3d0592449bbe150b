"""Every registered query against its SQL, and plans at a glance."""

import __spark_entry__ as entry
import pytest

from checks.run import compare, connect

SLOW = {"train_compare", "batch_score"}


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, folder, connection, name):
    problem = compare(entry.queries()[name](spark, folder), connection, entry.oracle_sql()[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_rows_only(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_filters_reach_the_scan(spark, folder):
    from tallyframe.operators.filters import apply_filters
    from tallyframe.plans.specs import Filter

    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    rows = apply_filters(lines, [Filter("l_quantity", "<", 5), Filter("l_linenumber", ">=", 2)]).select("l_tax")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # the plan text is cut after a hundred characters of filters
    pushed = plan.split("PushedFilters: [")[1]
    assert "LessThan(l_quantity,5.0)" in pushed and "GreaterThanOrEqual(l_l" in pushed
    assert "l_extendedprice" not in plan


def test_top_values_are_limited_before_the_shuffle(spark, folder):
    from tallyframe.operators.frequency import top_values, value_frequencies

    orders = spark.read.parquet(f"{folder}/orders.parquet")
    plan = top_values(value_frequencies(orders), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
