"""Joins to more rows than may be broadcast go by key, however few Spark takes them for."""

from quillgrid.llm import near_copies
from quillgrid.llm.common import ids_side, join_small, without_ids


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_are_not_broadcast(spark):
    """Spark took a table repeated for 32 salts for as small as its file and broadcast it."""
    rows, small = spark.range(60).selectExpr("id % 20 k", "id v"), spark.range(10).selectExpr("id k", "id * 2 w")
    for how, n in (("inner", 30), ("left", 60)):
        joined = join_small(rows, small, ["k"], how, broadcast_rows=9)
        assert "BroadcastHashJoin" not in plan(joined)
        assert sorted(map(str, joined.collect())) == sorted(map(str, rows.join(small, ["k"], how).collect())) and joined.count() == n
    assert "BroadcastHashJoin" in plan(join_small(rows, small, ["k"]))


def test_sets_of_many_nodes_are_not_broadcast(spark):
    docs = spark.range(20).selectExpr("id doc_id", "'a b c' text")
    assert "BroadcastHashJoin" not in plan(near_copies.hash_sets(docs, spark.range(200_001).selectExpr("id doc_id", "id node"), 5))


def test_many_ids_are_not_broadcast(spark):
    docs, ids = spark.range(20).selectExpr("id doc_id", "id v"), spark.range(5).selectExpr("id doc_id")
    left = without_ids(docs, ids, broadcast_rows=4)
    assert "BroadcastHashJoin" not in plan(left) and left.count() == 15
    assert "BroadcastHashJoin" not in plan(docs.join(ids_side(ids, 4), "doc_id", "left_semi"))
    assert "BroadcastHashJoin" in plan(without_ids(docs, ids))
