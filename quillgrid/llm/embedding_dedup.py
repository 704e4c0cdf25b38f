"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within squared distance B = 2 (1 - c). After a random rotation the
coordinates are cut into blocks; at least one block has a squared distance of at most its share of B. So
each block is range-joined under that budget: a cell of its first coordinate, as wide as the budget's
root, meets itself and the next one, and in a cell only pairs within the block's budget are candidates.
A candidate is verified on the whole vectors in double precision, in the first block that finds it.

Equal vectors are one class. A cell above ``chunk_rows`` rows is cut into chunks and each pair of chunks
is a group of its own. Groups emit link counts and spanning links, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import connected_components, join_counted, join_small, materialize
from quillgrid.llm.simhash import Forest


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[int]:
    return [dim * j // min(blocks, dim) for j in range(min(blocks, dim) + 1)]


def budget(edges: list[int], j: int, threshold: float) -> float:
    """The block's share of the squared distance, with room for rounding."""
    return 2 * (1 - threshold) * (edges[j + 1] - edges[j]) / edges[-1] * (1 + 1e-9) + 1e-12


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def matrix(column: pa.ListArray) -> np.ndarray:
    """Equally long lists as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector, label) -> bool:
    if label is None or vector is None or not len(vector) or vector.null_count:
        return False
    x = vector.to_numpy(zero_copy_only=False).astype(np.float64)
    return bool(np.isfinite(x).all() and np.linalg.norm(x) > 0)


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding and key: a digest of label and vector, null if the row links with nothing."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                vector, label = batch.column(2)[i], batch.column(1)[i].as_py()
                vector = vector.values if vector.is_valid else None
                if not batch.column(0)[i].is_valid or not usable(vector, label):
                    out.append(None)
                    continue
                x = vector.to_numpy(zero_copy_only=False) + 0.0  # -0.0 becomes 0.0
                out.append(hashlib.blake2b(repr(label).encode() + b":" + x.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["vec_id", "label", "embedding", "key"])

    return rows.mapInArrow(keys, f"vec_id long, label long, embedding {rows.schema['embedding'].dataType.simpleString()}, key binary")


def spread(classes: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """A row per class, block and cell that it belongs to (home) or visits from the cell before."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(3)], np.int64)
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                y, edges = units(matrix(part.column(3))) @ rotation(int(dim)).T, block_edges(int(dim), blocks)
                for j in range(len(edges) - 1):
                    width = budget(edges, j, threshold) ** 0.5
                    cell = np.floor(y[:, edges[j]] / width).astype(np.int64)
                    for visit in (0, 1):
                        same = lambda x: pa.array(np.full(len(part), x))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [part.column(1), same(np.int32(dim)), same(np.int32(j)), pa.array(cell + visit), same(bool(visit)), part.column(0), part.column(2), part.column(3)],
                            ["label", "dim", "block", "cell", "visits", "id", "n", "vector"],
                        )

    kind = classes.schema["vector"].dataType.simpleString()
    return classes.select("id", "label", "n", "vector").mapInArrow(cells, f"label long, dim int, block int, cell long, visits boolean, id long, n long, vector {kind}")


def near_pairs(a: np.ndarray, b: np.ndarray, j: int, edges: list[int], threshold: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of the pairs with cosine >= threshold whose first block within budget is j."""
    turn = rotation(a.shape[1]).T
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ya, yb = (a / na[:, None]) @ turn, (b / nb[:, None]) @ turn
    cut = slice(edges[j], edges[j + 1])
    most = budget(edges, j, threshold)
    sb = (yb[:, cut] ** 2).sum(axis=1)
    for start in range(0, len(a), step):
        block = ya[start : start + step, cut]
        distance = (block**2).sum(axis=1)[:, None] + sb - 2 * block @ yb[:, cut].T
        p, q = np.nonzero(distance <= most + 1e-9)
        for i in range(0, len(p), 1 << 18):
            x, z = p[i : i + (1 << 18)] + start, q[i : i + (1 << 18)]
            close = np.einsum("ij,ij->i", a[x], b[z]) / (na[x] * nb[z]) >= threshold
            x, z = x[close], z[close]
            first = ((ya[x, cut] - yb[z, cut]) ** 2).sum(axis=1) <= most
            for k in range(j):
                other = slice(edges[k], edges[k + 1])
                first &= ((ya[x, other] - yb[z, other]) ** 2).sum(axis=1) > budget(edges, k, threshold)
            yield x[first], z[first]


def embedding_components(rows: DataFrame, threshold: float = 0.93, blocks: int = 4, chunk_rows: int = 4000) -> DataFrame:
    """One row per row of rows (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are equal and their cosine in
    double precision is at least threshold. n_links counts the other rows linked directly, component_id
    is the smallest vec_id reachable and kept tells whether it is the row's own. A vector that is null,
    empty or zero or holds a null or non-finite component links with nothing; a row with a null vec_id
    takes no part (0 links, null component, not kept). Rows that repeat a vec_id count each; other columns
    are ignored; an empty table gives no rows.
    """
    kind = rows.schema["embedding"].dataType.simpleString()
    vector = "embedding" if kind == "array<float>" else "cast(embedding as array<double>) embedding"
    named = materialize(keyed(rows.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", vector)), "vectors")
    classes = materialize(
        named.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("vector"))
        .withColumn("id", F.xxhash64("key")),  # different vectors may repeat a vec_id
        "vector-classes",
    )
    cell = ["label", "dim", "block", "cell"]
    dealt = spread(classes, threshold, blocks)
    chunks = dealt.groupBy(*cell).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    grouped = (
        join_small(dealt, chunks, cell)
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
        .drop("other", "chunks")
    )

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda name: group.column(name).to_numpy()
        low, high, own, ids, n, visits = (column(x) for x in ("low", "high", "own", "id", "n", "visits"))
        j, x = int(column("block")[0]), matrix(group.column("vector").combine_chunks())
        edges, one = block_edges(x.shape[1], blocks), low[0] == high[0]
        left = np.flatnonzero(own == low[0])
        right = left if one else np.flatnonzero(own == high[0])
        links, forest, spanning = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        for p, q in near_pairs(x[left], x[right], j, edges, threshold):
            p, q = left[p], right[q]
            keep = ~(visits[p] & visits[q]) & ((p < q) if one else True) & (ids[p] != ids[q])
            p, q = p[keep], q[keep]
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            spanning += [(a, b) for a, b in zip(p.tolist(), q.tolist(), strict=True) if forest.join(a, b)]
        some = np.flatnonzero(links)
        return pa.table(
            {
                "u": pa.array(np.concatenate([ids[some], ids[[a for a, _ in spanning]] if spanning else []]).astype(np.int64)),
                "v": pa.array(np.concatenate([np.full(len(some), -1), ids[[b for _, b in spanning]] if spanning else []]).astype(np.int64)),
                "links": pa.array(np.concatenate([links[some], np.zeros(len(spanning))]).astype(np.int64)),
                "spans": pa.array(np.concatenate([np.zeros(len(some)), np.ones(len(spanning))]).astype(bool)),
            }
        )

    found = materialize(grouped.groupBy(*cell, "low", "high").applyInArrow(compare, "u long, v long, links long, spans boolean"), "vector-links")
    counts = found.where("not spans").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "id")
    parts = connected_components(found.where("spans").select("u", "v")).withColumnRenamed("node", "id")
    rooted = (
        classes.select("key", "id", "n", "least")
        .join(counts, "id", "left")
        .join(parts, "id", "left")
        .select("key", "least", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("root"))
    )
    settled = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("key", "n", "n_links", "component")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    alone = named.where("key is null").select("vec_id", F.lit(0).alias("n_links"), F.lit(None).cast("long").alias("component"))
    linked = join_counted(named.where("key is not null").select("vec_id", "key"), materialize(settled, "vector-classes"), ["key"])
    return alone.unionByName(linked.drop("key")).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


#: DuckDB SQL for embedding_components over embeddings, by all pairs of a label.
VECTOR_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND LEN(embedding) > 0
    AND LEN(LIST_FILTER(embedding, lambda c: c IS NULL OR NOT ISFINITE(c))) = 0),
y AS (SELECT *, SQRT(LIST_DOT_PRODUCT(v, v)) AS norm FROM x),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM y a JOIN y b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND LEN(a.v) = LEN(b.v) AND LIST_DOT_PRODUCT(a.v, b.v) / (a.norm * b.norm) >= 0.93),
r AS (SELECT u AS vec_id, u AS reached FROM l UNION SELECT r.vec_id, l.v FROM r JOIN l ON r.reached = l.u),
c AS (SELECT vec_id, MIN(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, COUNT(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, COALESCE(n_links, 0)::BIGINT AS n_links, COALESCE(component_id, e.vec_id) AS component_id,
       COALESCE(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
