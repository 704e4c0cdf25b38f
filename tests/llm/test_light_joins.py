"""Tables of many keys are joined by key, not broadcast."""

from quillgrid.llm.common import join_counted, light_side


def test_many_keys_are_not_broadcast(spark):
    rows = spark.range(20).selectExpr("id k", "id v")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(rows.join(light_side(rows.select("k"), 100_001), "k"))
    assert join_counted(rows, rows.selectExpr("k", "cast(1 as long) n", "v w"), ["k"]).where("v = w").count() == 20
