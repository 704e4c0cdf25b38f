"""Streams of documents and of edits: chunked rendering, refreshed includes, and revisioned editor state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgrid.operators import blocks as B
from quillgrid.operators.inlines import inline_html
from quillgrid.sources.text import chunks


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, source string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def line_html(docs: DataFrame) -> DataFrame:
    """Stateless rendering of prose lines: works alike on streams and tables, one narrow step."""
    rows = B.classify(B.scan(docs)).where("form = 'text'")
    return rows.select("doc_id", "line_no", inline_html("line").alias("text"))


def write_chunks(docs: DataFrame, path: str, checkpoint: str, size: int = 4096):
    """Render each micro-batch and write its chunks; a batch that fails leaves nothing behind and runs again."""

    def batch(df: DataFrame, epoch: int) -> None:
        chunks(line_html(df), size).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(availableNow=True).start()


def refresh_includes(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents to expand again: a stream of changed paths joined to the table of include edges (doc_id, path)."""
    return changed.join(edges, "path").select("doc_id", "path")


def apply_edits(edits: DataFrame) -> DataFrame:
    """Stream of edits (doc_id, revision, start, stop, text) -> doc_id, revision, source, applied.

    State per document is its revision and source. An edit counts only against the current revision and
    inside the source; others come back with applied false and change nothing. Edits of a batch go by revision,
    start, stop and text. A first edit with revision
    0 starts from an empty source.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, source = state.get if state.exists else (0, "")
        out = []
        for frame in frames:
            for e in frame.sort_values(["revision", "start", "stop", "text"]).itertuples():
                fits = e.revision == revision and 0 <= e.start <= e.stop <= len(source)
                if fits:
                    source, revision = source[: e.start] + e.text + source[e.stop :], revision + 1
                out.append((key[0], revision, source, bool(fits)))
        state.update((revision, source))
        yield pd.DataFrame(out, columns=["doc_id", "revision", "source", "applied"])

    return edits.groupBy("doc_id").applyInPandasWithState(
        step, "doc_id long, revision int, source string, applied boolean", "revision int, source string", "append", GroupStateTimeout.NoTimeout
    )
