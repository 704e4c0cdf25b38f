"""Tables that grow with the documents are joined by key, however small their files."""

from quillgrid.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_document_tables(spark):
    """These sent one side of a join through the driver and held it whole in each task."""
    for name in ("j17_t8_identity", "r16_a3_endnotes"):
        assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, SF))
