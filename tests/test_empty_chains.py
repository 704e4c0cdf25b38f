"""Emptied containers go at every depth."""

from quillgrid.operators import policy


def test_long_chains_of_empty_containers_go(spark):
    rows = [(1, i, i - 1, "list" if i % 2 else "list_item") for i in range(1, 12)]
    rows += [(2, i, i - 1, "list" if i % 2 else "list_item") for i in range(1, 12)] + [(2, 12, 6, "text")]
    got = policy.drop_empty(spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long, type string"), ("list", "list_item"))
    assert sorted((r.doc_id, r.node_id) for r in got.collect()) == [(2, 1), (2, 2), (2, 3), (2, 4), (2, 5), (2, 6), (2, 12)]
