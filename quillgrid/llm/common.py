"""Shared pieces: batches, joins to small tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.sources.shared import by_key, discard, materialize, shared_folder

__all__ = ["by_key", "connected_components", "discard", "ids_side", "join_counted", "join_small", "light_side", "materialize", "release_shuffles", "shared_folder", "small_batches", "table", "without_ids"]

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
#: ``bytes.split()`` cuts at the same six characters.
WORD = "[^\\x20\\x09-\\x0D]+"


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to at most ``rows`` rows, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now instead of at its next periodic collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_ids(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of docs whose doc_id is not among ids (doc_id); a null doc_id stays.

    The ids are counted first: up to broadcast_rows of them (8 bytes each) are broadcast so that the texts
    need no shuffle; more are joined by key.
    """
    return docs.join(ids_side(ids, broadcast_rows), "doc_id", "left_anti").select(docs.columns)


def ids_side(ids: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """ids for a join: up to broadcast_rows are broadcast, more never are."""
    return F.broadcast(ids) if ids.limit(broadcast_rows + 1).count() <= broadcast_rows else by_key(ids)


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """rows joined to one row per key of small, without dealing rows out by a key that may hold many of them.

    small is counted first: up to broadcast_rows it is broadcast; beyond, each of its rows is repeated for
    ``salts`` salts and rows spread over them. Those are joined by key: Spark takes them for as few as
    before they were repeated, so it would broadcast them through the driver.
    """
    if small.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(small), keys, how)
    spread = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    return rows.withColumn("salt", salt).join(by_key(spread), [*keys, "salt"], how).drop("salt")


def light_side(rows: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """rows, n of them, for a join: more than ``most`` are never broadcast, however small their file."""
    return by_key(rows) if n > most else rows


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], how: str = "inner", most_heavy: int = 10_000) -> DataFrame:
    """rows joined to one row per key of counted, whose column n (dropped) tells how many of rows have the key.

    A key that more than 1,000 rows and more than one in most_heavy of all have is heavy. There are fewer
    than most_heavy of them, so they are broadcast and their rows stay where they are; the others are
    joined by key. rows and counted are read several times: written tables serve best.
    """
    total, keys_held = counted.agg(F.sum("n"), F.count("*")).first()
    limit = max(1000, (total or 0) // most_heavy)
    heavy, light = counted.where(F.col("n") > limit).drop("n"), light_side(counted.where(F.col("n") <= limit).drop("n"), keys_held)
    if heavy.isEmpty():
        return rows.join(light, keys, how)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(rest)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given as (u, v) long pairs: (node, component), component the least node.

    Alternates large-star and small-star rounds; each star is a minimum per node (combined before the
    shuffle) joined back to the edges. The few nodes with a large share of the edges are joined by a
    broadcast, so no node's neighbours are ever gathered in one place. Every round is written to the shared
    folder. Nodes without an edge do not appear; no edges, no rows.
    """
    e = materialize(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n")), "stars")
        large = join_counted(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        below = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars")
        small = join_counted(large, below, ["u"])
        before, e = e, materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        discard(before, least, large, below)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.union(roots).distinct()
