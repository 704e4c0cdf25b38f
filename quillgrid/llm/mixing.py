"""Mixing sources to target weights, with DataFrame operations alone.

Every document gets a hash-random key; documents are laid out by ranges of the key's high bits within their
source, so that their order is the key's own at any number of ranges; range totals give each range its offset, and a running sum inside the range gives each document its place
in the source's random order. A source's budget is cut at exactly its last word: whole repeats of the
source first, then the documents that begin before the rest of the budget ends.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import WORD, materialize


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """sizes (src, source, source_size) plus target: the sum of all sizes shared by weight, none above its limit.

    Sources are taken by how soon they fill (limit over weight). The first that doesn't fill when all
    before it have filled fixes the level at which the others stop; all sums up to there are whole
    numbers, so every engine gets the same doubles. One row per source goes through one task here.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy(max_repeats * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.row_number().over(named) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), F.pmod(rank, len(weights)) + 1)
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("nth", F.row_number().over(filled))
        .withColumn("left", F.sum("source_size").over(everything) - max_repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("weight") * F.col("left") > max_repeats * F.col("source_size") * F.col("open"))
    )
    level = F.min_by(F.when(~F.col("full"), F.col("left") / F.col("open")), F.when(~F.col("full"), F.col("nth"))).over(everything)
    share = F.coalesce(F.col("weight") * level, F.lit(0.0))
    target = F.when(F.col("full"), (max_repeats * F.col("source_size")).cast("double")).otherwise(share)
    return rows.select("src", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, ranges: int = 1024, seed: str = "mix", range_rows: int = 1_000_000) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    size: the text's words (null text: 0). Sources in code point order, null last, weigh ``weights`` in
    turn and share the sum of all sizes; a target stops at max_repeats times its source's size and the
    excess goes to the others. taken: words the mix takes of this row, repeats counted; per source they
    sum to the whole part of its target. Each of a source's key ranges is one task's work: there are ``ranges``
    of them, more where they would hold over range_rows rows (at most 2^28). The order depends on doc_id and seed alone
    (null ids: on the text), not on the ranges, so reruns agree. Repeated rows count each; an empty table gives no rows.
    """
    doc_id, source = F.col("doc_id"), F.col("source")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5("text"), F.lit(""))))
    ranges *= 2 ** max(0, ceil(log2(max(1, docs.count()) / range_rows / ranges)))
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("src"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
        ).withColumn("range", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * ranges / 2**28).cast("int")),
        "mix",
    )
    totals = sized.groupBy("src", "range").agg(F.sum("size").alias("range_size"), F.first("source").alias("source"))
    sizes = totals.groupBy("src").agg(F.sum("range_size").alias("source_size"), F.first("source", ignorenulls=True).alias("source"))
    earlier = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        totals.select("src", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
        .join(source_targets(sizes, weights, max_repeats), "src")
        .withColumn("repeats", F.coalesce(F.expr("try_divide(floor(target), source_size)"), F.lit(0)).cast("long"))
        .withColumn("rest", F.floor("target") - F.col("repeats") * F.col("source_size"))
    )
    ahead = Window.partitionBy("src", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(offsets, ["src", "range"]).withColumn("at", F.col("offset") + F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("repeats") * F.col("size") + part).cast("long").alias("taken"))


#: DuckDB SQL for mix_sources with its default parameters over the view or table {docs}.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         MD5('mix:' || COALESCE(doc_id::VARCHAR, MD5(text), '')) AS key
  FROM {docs}),
s AS (
  SELECT source, SUM(size)::BIGINT AS source_size, ((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS nth FROM s),
g AS (
  SELECT *, (SUM(source_size) OVER () - 3 * COALESCE(SUM(source_size) OVER w, 0))::BIGINT AS lft,
         (SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0))::BIGINT AS opn
  FROM f WINDOW w AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, weight * lft > 3 * source_size * opn AS filled FROM g),
t AS (
  SELECT source, source_size, CASE WHEN filled THEN (3 * source_size)::DOUBLE
    ELSE COALESCE(weight * (SELECT ARG_MIN(lft / opn, nth) FROM h WHERE NOT filled), 0.0) END AS target
  FROM h),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN FLOOR(FLOOR(t.target) / t.source_size)::BIGINT ELSE 0 END AS repeats,
         COALESCE(SUM(d.size) OVER (PARTITION BY d.source
           ORDER BY d.key, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (repeats * size + GREATEST(0, LEAST(size, FLOOR(target)::BIGINT - repeats * source_size - pos)))::BIGINT AS taken
FROM p
"""
