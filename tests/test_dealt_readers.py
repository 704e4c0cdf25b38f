"""Readers deal a small file out over tasks."""

from pyspark.sql import functions as F

from quillgrid.operators import blocks, frames


def test_a_small_file_is_read_by_many_tasks(spark, tmp_path):
    """One file of short rows used to be one task of the readers."""
    spark.range(400).selectExpr("id doc_id", "concat('# h', id) source").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for rows in (frames.nested(docs), blocks.scan(docs)):
        dealt = rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
        assert len(dealt) >= 4 and sum(r.n for r in dealt) == 400 and max(r.n for r in dealt) < 200
