"""Plans of the coupon-shaped views."""

from tallyroll.sources import derived


def test_views_are_pruned(spark):
    df = derived.issue(spark, "/root/testdata/sf0.001").filter("event_id = 3").groupBy("event_id").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "o_custkey" not in plan and "o_orderstatus" not in plan and "md5" not in plan
