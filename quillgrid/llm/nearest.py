"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample and broadcast; every vector is put in a leaf. A query walks the tree
with a priority queue, the most promising node first, and visits as many leaves as a calibration found to be
needed: the exact neighbours of a bounded set of queries tell at which visit each would have been met,
and visits widen until the aimed share is reached.

Leaves that follow each other in the tree share a chunk of bounded size, and a large leaf is cut into several. A
query goes once to each chunk in which it visits a leaf, in blocks of queries, so a group holds at most one
chunk and one block. Groups give each query its best, Spark merges them. Equal vectors are one class, which keeps
the few smallest ids that could be asked for.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import discard, materialize


class KMeansTree:
    """Nodes in the order of a walk, each with a centre, a spread, its children and the number of its leaf (-1: none)."""

    def __init__(self, sample: np.ndarray, branch: int, leaf_rows: int, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.spreads: list[float] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.leaves = 0
        self._grow(sample, branch, leaf_rows, np.random.default_rng(seed))
        self.centres, self.spreads = np.array(self.centres), np.array(self.spreads)

    def _grow(self, x: np.ndarray, branch: int, leaf_rows: int, rng: np.random.Generator) -> int:
        at, centre = len(self.leaf), x.mean(axis=0)
        self.centres.append(centre)
        self.spreads.append(float(np.sqrt(((x - centre) ** 2).mean())))
        self.children.append([])
        self.leaf.append(-1)
        parts = split(x, min(branch, -(-len(x) // leaf_rows)), rng) if len(x) > leaf_rows else []
        if len(parts) < 2:
            self.leaf[at], self.leaves = self.leaves, self.leaves + 1
        else:
            self.children[at] = [self._grow(part, branch, leaf_rows, rng) for part in parts]
        return at

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree by the nearest centre."""
        found, open_ = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if not self.children[node]:
                found[rows] = self.leaf[node]
                continue
            children = np.array(self.children[node])
            nearest = closest(x[rows], self.centres[children])
            open_ += [(int(child), rows[nearest == i]) for i, child in enumerate(children) if (nearest == i).any()]
        return found

    def visits(self, queries: np.ndarray, most: int) -> Iterator[list[int]]:
        """Per query the first ``most`` leaves, best bin first: by the product with the centre and what the node's spread may add."""
        worth = queries @ self.centres.T + 2 * np.linalg.norm(queries, axis=1)[:, None] * self.spreads
        for row in (-worth).tolist():
            found, queue = [], [(row[0], 0)]
            while queue and len(found) < most:
                _, node = heapq.heappop(queue)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(queue, (row[child], child))
                else:
                    found.append(self.leaf[node])
            yield found


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> list[np.ndarray]:
    """k-means from centres drawn in proportion to the squared distance; empty parts are left out."""
    centres = x[rng.integers(len(x))][None]
    while len(centres) < k:
        far = np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T, 0).min(axis=1)
        if far.sum() <= 0:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        near = closest(x, centres)
        centres = np.array([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
    near = closest(x, centres)
    return [x[near == i] for i in range(len(centres)) if (near == i).any()]


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in the same order wherever a pair stands."""
    return (a * b).sum(axis=1)


def usable(vector: F.Column) -> F.Column:
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda c: c != 0), F.lit(False))


def vector_classes(rows: DataFrame, k: int) -> DataFrame:
    """Each distinct vector once, with the k + 1 smallest vec_ids of its rows; they are thinned before the shuffle."""
    by = Window.partitionBy("vector").orderBy("vec_id")
    thinned = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    return thinned.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def best_of_parts(classes: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """The k nearest of each of a bounded set of queries, its own vector left out, with their leaves, by brute force: (q, score, leaf)."""
    lengths = (queries**2).sum(axis=1)[:, None]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, leaves = np.full((len(queries), 0), 0.0), np.full((len(queries), 0), 0)
        for batch in batches:
            for start in range(0, len(batch), 4096):
                part = batch.slice(start, 4096)
                x = matrix(part.column(1))
                now, both = queries @ x.T, lengths + (x**2).sum(axis=1)
                now[both - 2 * now <= 1e-9 * both] = -np.inf
                scores = np.hstack([scores, now])
                leaves = np.hstack([leaves, np.broadcast_to(part.column(0).to_numpy(), now.shape)])
                if scores.shape[1] > k:
                    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    scores, leaves = np.take_along_axis(scores, top, 1), np.take_along_axis(leaves, top, 1)
        q = np.repeat(np.arange(len(queries), dtype=np.int32), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(scores.ravel()), pa.array(leaves.ravel().astype(np.int32))], ["q", "score", "leaf"])

    found = classes.select("leaf", "vector").mapInArrow(scan, "q int, score double, leaf int")
    return found.where(F.col("score") > float("-inf")).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("r") <= k).drop("r")


def calibrated_visits(tree: KMeansTree, classes: DataFrame, queries: np.ndarray, k: int, recall: float) -> int:
    """The least number of leaves with which the walks of queries meet the aimed share of their exact neighbours."""
    order = [{leaf: i for i, leaf in enumerate(walk)} for walk in tree.visits(queries, tree.leaves)]
    met = sorted(order[r.q][r.leaf] for r in best_of_parts(classes, queries, k).collect())
    for visits in range(1, tree.leaves):
        if np.searchsorted(met, visits) >= recall * len(met):
            return visits
    return tree.leaves


def sampled(classes: DataFrame, rows: int, n: int, seed: int) -> np.ndarray:
    """About rows of the n classes, drawn by a hash of the vector."""
    drawn = F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 30))
    taken = classes.select("vector") if n <= rows else classes.select("vector").where(drawn < int(rows / n * (1 << 30)) + 1)
    return np.array([r[0] for r in taken.orderBy("vector").collect()], np.float64)


def search(classes: DataFrame, queries: DataFrame, tree: KMeansTree, visits: int, k: int, chunk_rows: int, block_rows: int) -> DataFrame:
    """query_id, vec_id, score: at least the k best of what each query visits."""
    counts = dict(classes.groupBy("leaf").count().collect())
    first, parts, held = np.zeros(tree.leaves, np.int32), np.ones(tree.leaves, np.int32), 0
    last = 0
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if held and held + n > chunk_rows:
            last, held = last + 1, 0
        first[leaf], parts[leaf] = last, max(1, -(-n // chunk_rows))
        held += n
        if parts[leaf] > 1:
            last, held = last + int(parts[leaf]), 0
    blocks = max(1, -(-queries.count() // block_rows))

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, h = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(first[leaf] + (h % parts[leaf]).astype(np.int32)), *batch.columns], ["chunk", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                at, chunks, seen = [], [], []
                for i, leaves in enumerate(tree.visits(matrix(batch.column(1)), visits)):
                    wanted: dict[int, list[int]] = {}
                    for leaf in leaves:
                        for c in range(first[leaf], first[leaf] + parts[leaf]):
                            wanted.setdefault(c, []).append(leaf)
                    at += [i] * len(wanted)
                    chunks += wanted
                    seen += wanted.values()
                part = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(seen, pa.list_(pa.int32())), *part.columns], ["chunk", "leaves", *part.schema.names])

    kind = classes.schema["vector"].dataType.simpleString()
    stored = (
        classes.select("leaf", F.pmod(F.xxhash64("vector"), F.lit(1 << 30)).alias("h"), "vector", "ids")
        .mapInArrow(chunk, f"chunk int, leaf int, h long, vector {kind}, ids array<long>")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    asked = queries.select("query_id", "vector").mapInArrow(walk, f"chunk int, leaves array<int>, query_id long, vector {kind}").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if len(left) and len(right):
            left = left.sort_by("leaf").combine_chunks()
            leaf, x, ids = left.column("leaf").to_numpy(), matrix(left.column("vector").combine_chunks()), left.column("ids").to_pylist()
            right = right.combine_chunks()
            q, query_ids, seen = matrix(right.column("vector").combine_chunks()), right.column("query_id").to_pylist(), right.column("leaves").to_pylist()
            asks: dict[int, list[int]] = {}
            for i, leaves in enumerate(seen):
                for one in leaves:
                    asks.setdefault(one, []).append(i)
            scores = np.full((len(q), len(x)), -np.inf)
            for one, of in asks.items():
                a, b = np.searchsorted(leaf, [one, one + 1])
                if b > a:
                    scores[of, a:b] = q[of] @ x[a:b].T
            most, room = min(k + 1, len(x)), 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
            least = -np.partition(-scores, most - 1, axis=1)[:, most - 1] - room
            for i in range(len(q)):
                near = np.flatnonzero((scores[i] >= least[i]) & (scores[i] > -np.inf))
                pairs = []
                for j, score in zip(near.tolist(), products(x[near], q[i][None]).tolist(), strict=True):
                    kept = list(ids[j])
                    if query_ids[i] in kept and (x[j] == q[i]).all():
                        kept.remove(query_ids[i])  # the query's own row
                    pairs += [(-score, vec_id) for vec_id in kept]
                for score, vec_id in heapq.nsmallest(k, pairs):
                    for column, value in zip(found, (query_ids[i], vec_id, -score), strict=True):
                        column.append(value)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return stored.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(lambda a, b: compare(a, b), "query_id long, vec_id long, score double")


def nearest_neighbours(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    recall: float = 0.95,
    branch: int = 16,
    sample_rows: int = 20_000,
    leaf_rows: int = 20,
    calibration_rows: int = 128,
    chunk_rows: int = 4096,
    block_rows: int = 1024,
    megabytes: int = 32,
) -> DataFrame:
    """The k nearest found (all, if fewer) of each row of queries among rows (both vec_id, embedding): query_id, rank, vec_id, score.

    Nearness is the largest inner product in double precision, ties go to the smaller vec_id; queries are among
    rows, and a query's own row is no candidate (one row with its vec_id and its vector). The tree is fitted on about
    sample_rows distinct vectors and calibrated by about calibration_rows queries, each at most megabytes of doubles; every
    vector is indexed. recall is the share of exact neighbours at which calibration stops widening. Vectors that are null, empty or zero
    or hold null or non-finite components, and rows with a null vec_id, take no part. A query meets
    vectors of its own length only. Rows that repeat a vec_id are candidates each; of queries that repeat one, the least
    vector asks. Other columns are ignored; empty tables give no rows.
    """
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    ready = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    asking = materialize(ready(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumnRenamed("vec_id", "query_id"), "queries")
    classes = materialize(vector_classes(ready(rows), k), "vector-classes")
    found = []
    for length, n in classes.groupBy(F.size("vector")).count().orderBy(F.size("vector")).collect():
        of_length = lambda df: df.where(F.size("vector") == length)  # noqa: B023, E731
        bounded = lambda most: max(1, min(most, (megabytes << 20) // (8 * length)))  # noqa: B023, E731
        asked = of_length(asking)
        tests = sampled(asked, bounded(calibration_rows), asked.count(), 2)
        if not len(tests):
            continue
        tree = KMeansTree(sampled(of_length(classes), bounded(sample_rows), n, 1), branch, leaf_rows)

        def place(batches: Iterator[pa.RecordBatch], tree: KMeansTree = tree) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(tree.assign(matrix(batch.column(0)))), *batch.columns], ["leaf", *batch.schema.names])

        placed = materialize(of_length(classes).select("vector", "ids").mapInArrow(place, f"leaf int, vector {kind}, ids array<long>"), "leaves")
        visits = calibrated_visits(tree, placed, tests, k, recall)
        near = search(placed, asked, tree, visits, k, bounded(chunk_rows), bounded(block_rows))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found.append(materialize(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "nearest"))
        discard(placed)
    discard(classes, asking)
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")
