import pytest

from siltstone.plans import catalogue
from tests.oracle import assert_same

SQL = catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(catalogue.queries()[name](spark, sf_dir), SQL[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["source_id", "account_id", "scheduled_slot", "dispatch_key", "task_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_feed_plan_is_top_k(spark, sf_dir):
    plan = catalogue.feed_recent(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_match_has_no_nested_loop(spark, sf_dir):
    plan = catalogue.event_match_ranked(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
