"""Emptied containers go in one pass, without rounds."""

import random

from quillgrid.operators import policy


def test_emptied_chains_go_in_one_pass(spark):
    """Any depth, any order of rows, repeated ids, other columns; against rounds over a dict."""
    rnd = random.Random(3)
    rows = []
    for doc in [*range(60), None]:
        for i in rnd.sample(range(1, 30), 29):
            rows.append((None if doc is None else f"d{doc}", i, rnd.choice([None, *range(max(0, i - 3), i)]), rnd.choice(["list", "list_item", "list", "text"]) if i % 7 else "list", i * 0.5))
        rows.append((None if doc is None else f"d{doc}", 29, rnd.randint(1, 20), "list", 1.0))
    rows += [("deep", i, i - 1, "list", 0.0) for i in range(1, 3001)]
    left = rows
    while True:
        parents = {(d, p) for d, _, p, _, _ in left}
        empty = {(d, n) for d, n, _, t, _ in left if t != "text" and d is not None and (d, n) not in parents}
        if not empty:
            break
        left = [r for r in left if (r[0], r[1]) not in empty]
    nodes = spark.createDataFrame(rows, "doc_id string, node_id long, parent_id long, type string, weight double").repartition(3)
    runs = spark.sparkContext.statusTracker()
    before = len(runs.getJobIdsForGroup(None))
    got = policy.drop_empty(nodes, ("list", "list_item"))
    assert len(runs.getJobIdsForGroup(None)) == before  # no round runs while the plan is made
    key = lambda r: (str(r[0]), r[1], str(r[2]), r[3])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(left, key=key)
