"""Streams: chunked rendering by micro-batch, and editor state by document."""

import pandas as pd

from quillgrid.streaming import updates


def test_chunks_are_written_per_batch(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a *b*\n\n" + "x" * 3000), (2, "# head"), (3, None)], "doc_id long, source string").write.parquet(source)
    stream = updates.document_stream(spark, source)
    updates.write_chunks(stream, out, f"{tmp_path}/check", 1024).awaitTermination()
    got = spark.read.parquet(out)
    assert got.where("chunk like 'a <strong>%'").count() == 1
    assert got.where("length(chunk) > 256").count() == 0
    whole = "".join(r.chunk for r in got.where("chunk like 'x%'").orderBy("chunk_no").collect())
    assert whole == "x" * 3000
    spark.createDataFrame([(4, "more")], "doc_id long, source string").write.mode("append").parquet(source)
    updates.write_chunks(updates.document_stream(spark, source), out, f"{tmp_path}/check", 1024).awaitTermination()
    assert spark.read.parquet(out).where("doc_id = 4").count() == 1


def test_editor_state(spark, tmp_path):
    source = f"{tmp_path}/edits"
    edits = [(1, 0, 0, 0, "hello"), (1, 1, 5, 5, " world"), (1, 0, 0, 0, "stale"), (1, 2, 0, 1, "J"), (2, 0, 0, 0, "x"), (2, 1, 0, 9, "past the end")]
    spark.createDataFrame(edits, "doc_id long, revision int, start int, stop int, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, revision int, start int, stop int, text string").parquet(source)
    query = updates.apply_edits(stream).writeStream.format("memory").queryName("edited").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = pd.DataFrame([r.asDict() for r in spark.sql("select * from edited").collect()])
    last = got[got.applied].groupby("doc_id").last()
    assert last.loc[1].source == "Jello world" and last.loc[1].revision == 3 and last.loc[2].source == "x"
    assert len(got[~got.applied]) == 2
