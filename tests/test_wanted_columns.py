"""The reader of blocks makes the columns that are asked for and no others."""

from pyspark.sql import functions as F

from quillgrid.operators.frames import nested
from quillgrid.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_depths_alone_are_those_of_whole_rows(spark):
    """Blocks by depth used to be counted over rows of 26 columns."""
    docs = spark.createDataFrame([(1, "- a\n  > b\n\n    - c\n%% d\n\ne"), (2, ""), (3, None), (4, "::: note\n# H\n\n- i\n- j\n:::")], "doc_id long, source string")
    whole, lean = nested(docs), nested(docs, ["depth"])
    assert lean.columns == ["doc_id", "depth"]
    assert sorted(lean.collect()) == sorted(whole.select("doc_id", F.size("path").alias("depth")).collect())
    assert nested(docs, ["text", "path"]).columns == ["doc_id", "path", "text"]


def test_depths_are_counted_over_depths(spark):
    assert "text#" not in QUERIES["j10_nested_depths"](spark, SF)._jdf.queryExecution().analyzed().toString()


def test_text_targets_make_each_piece_once(spark):
    """A filter on a row's opening piece had Spark make the piece twice, and its prefixes once a line."""
    plan = QUERIES["r26_s22_nested_ansi"](spark, SF)._jdf.queryExecution()
    assert "item_attributes" not in plan.analyzed().toString()
    filters = [line for line in plan.optimizedPlan().toString().split("\n") if "Filter" in line]
    assert not any("CASE WHEN" in line for line in filters)
    assert plan.optimizedPlan().toString().count("AS hang#") == 1
