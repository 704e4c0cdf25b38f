"""Embedding whitening on distinct vectors, weighted by one or by their multiplicity.

Vectors are put on an integer grid, x = floor(scale * c), and rows with the same x are one class. Tasks sum
x, and then the centred products, over their classes as one weighted matrix product each; Spark adds the
tasks' sums. The eigenvectors of the covariance, whose size is the dimension's square, are found on the driver. Every
class is whitened once, and rows meet their class again by a digest of x.

Vectors of different lengths are whitened apart, each length by its own fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import discard, join_counted, materialize

LONGEST = 2**63 - 1


def on_grid(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, x (longs) and key (a digest of x) of the rows whose vector is whole and finite."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for batch in batches:
            at, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
            y = np.floor(scale * values)
            beyond = y >= 2.0**63
            x = np.maximum(np.where(beyond, 0, y), -(2.0**63)).astype(np.int64)
            x[beyond] = LONGEST
            keys = [hashlib.blake2b(x[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(x[at[0] : at[-1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(kind), pa.array(keys, pa.binary())], ["vec_id", "x", "key"])

    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    return whole.mapInArrow(place, "vec_id long, x array<long>, key binary")


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """A batch's rows of each length and their x (column x) as a matrix; empty vectors are left out."""
    lists = batch.column("x")
    lengths = np.diff(lists.offsets.to_numpy())
    for d in np.unique(lengths[lengths > 0]):
        part = batch.filter(pa.array(lengths == d))
        yield int(d), part, part.column("x").flatten().to_numpy().reshape(len(part), d)


def exact_sums(x: np.ndarray, w: np.ndarray) -> list[int]:
    """Per column the sum of w * x, exactly."""
    if int(w.max()) * len(x) >= 1 << 30:
        return [int(v) for v in (x.astype(object) * w.astype(object)[:, None]).sum(axis=0)]
    low = ((x & 0xFFFFFFFF) * w[:, None]).sum(axis=0)
    high = ((x >> 32) * w[:, None]).sum(axis=0)
    return [(int(h) << 32) + int(lo) for h, lo in zip(high, low, strict=True)]


def fit_sums(classes: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length the weights' total and the weighted sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for d, part, x in by_length(batch):
                w = part.column("w").to_numpy()
                now = [int(w.sum()), *exact_sums(x, w)]
                total[d] = [a + b for a, b in zip(total[d], now, strict=True)] if d in total else now
        flat = [(d, i, Decimal(v)) for d, sums in total.items() for i, v in enumerate(sums)]
        kinds = (pa.int32(), pa.int32(), pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], kind) for k, kind in enumerate(kinds)], ["d", "i", "v"])

    found: dict[int, dict[int, int]] = {}
    for d, i, v in classes.select("x", "w").mapInArrow(add, "d int, i int, v decimal(38,0)").groupBy("d", "i").agg(F.sum("v")).collect():
        found.setdefault(d, {})[i] = int(v)
    return {d: (s[0], [s[i + 1] for i in range(d)]) for d, s in found.items()}


def covariances(classes: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length the weighted covariance, centred before multiplying."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for d, part, x in by_length(batch):
                n, s = sums[d]
                centred = x - np.array([v / n for v in s])
                now = (centred * part.column("w").to_numpy()[:, None]).T @ centred
                total[d] = total[d] + now if d in total else now
        for d, products in total.items():
            for i in range(d):
                row = products[i, i:]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d - i, d, np.int32)), pa.array(np.full(d - i, i, np.int32)), pa.array(np.arange(i, d, dtype=np.int32)), pa.array(row)], ["d", "i", "j", "v"])

    found = {d: np.zeros((d, d)) for d in sums}
    for d, i, j, v in classes.select("x", "w").mapInArrow(multiply, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v")).collect():
        found[d][i, j] = found[d][j, i] = v / sums[d][0]
    return found


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first eigenvectors (rows) by falling eigenvalue, their eigenvalues (0 if not above rounding) and shares of the trace."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1].T[:most]
    trace = float(np.trace(covariance))
    values = np.where(values > len(covariance) * np.finfo(float).eps * trace, values, 0.0)
    return vectors, values, values / trace if trace > 0 else np.full(len(values), np.nan)


def deviations(x: np.ndarray, n: int, s: list[int]) -> tuple[list[int | None], np.ndarray]:
    """Per row the exact sum of (n * x - s)**2, None beyond a long, and n * x - s as doubles."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(v) for v in s)
    if x.shape[1] * most**2 <= LONGEST:
        apart = n * x - np.array(s, np.int64)
        return (apart**2).sum(axis=1).tolist(), apart.astype(np.float64)
    apart = x.astype(object) * n - np.array(s, object)
    found = [int(v) for v in (apart * apart).sum(axis=1)]
    return [v if v <= LONGEST else None for v in found], apart.astype(np.float64)


def whiten(rows: DataFrame, most: int = 4, scale: int = 256, weights: str = "one") -> DataFrame:
    """For each row of rows (vec_id, embedding) with a usable vector and each component up to ``most``: vec_id,
    component, n, deviation, whitened, explained, identity_error.

    A vector that is null or holds a null or non-finite entry is dropped; entries beyond a long after scaling count as
    the nearest long. With weights "one" each distinct x is fitted once, with "count" as often as rows have it; n is the
    weights' total and covariances divide by it. deviation is exact, null beyond a long. A component without variance
    (a single distinct vector, constant dimensions) has null whitened; explained is null if no dimension varies, and
    identity_error covers the components with variance, null if there are none. Vectors of different lengths are fitted apart;
    empty ones have no components, so no rows. Rows that repeat a vec_id, or have none, each come back; other
    columns are ignored; an empty table gives no rows.
    """
    if weights not in ("one", "count"):
        raise ValueError("weights are one or count")
    placed = materialize(on_grid(rows, scale), "grid")
    counted = placed.groupBy("key").agg(F.first("x").alias("x"), F.count("*").alias("n"))
    classes = materialize(counted.withColumn("w", F.col("n") if weights == "count" else F.lit(1).cast("long")), "distinct")
    sums = fit_sums(classes)
    fitted = {d: components(c, most) for d, c in covariances(classes, sums).items()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in by_length(batch):
                (n, s), (vectors, values, _) = sums[d], fitted[d]
                deviation, apart = deviations(x, n, s)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out = (apart / n) @ vectors.T / np.sqrt(values)
                lists = [[None if e == 0 else float(v) for v, e in zip(row, values, strict=True)] for row in out]
                arrays = [pa.array(np.full(len(part), d, np.int32)), part.column("n"), part.column("w"), pa.array(deviation, pa.int64()), pa.array(lists, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("key"), *arrays], ["key", "d", "n", "w", "deviation", "whitened"])

    spark = rows.sparkSession
    whitened = materialize(classes.mapInArrow(project, "key binary, d int, n long, w long, deviation long, whitened array<double>"), "whitened")
    facts = []
    for d, (vectors, values, shares) in sorted(fitted.items()):
        k = int((values > 0).sum())
        error = identity_error(whitened.where(F.col("d") == d), k) if k else None
        total = min(sums[d][0], LONGEST)
        facts += [(d, c, total, None if np.isnan(shares[c]) else float(shares[c]), error) for c in range(len(vectors))]
    told = spark.createDataFrame(facts, "d int, c int, total long, explained double, identity_error double")
    whole = join_counted(placed.select("vec_id", "key"), whitened.drop("w"), ["key"])
    each = whole.select("vec_id", "d", "deviation", F.posexplode("whitened").alias("c", "whitened"))
    found = each.join(F.broadcast(told), ["d", "c"]).select(
        "vec_id", (F.col("c") + 1).cast("int").alias("component"), F.col("total").alias("n"), "deviation", "whitened", "explained", "identity_error"
    )
    discard(classes)
    return found


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the weighted covariance of the first k whitened components minus the identity."""
    w, value = F.col("w"), [F.col("whitened")[i] for i in range(k)]
    total, *means = whitened.agg(F.sum(w), *[F.sum(w * v) / F.sum(w) for v in value]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    entries = whitened.agg(*[F.sum(w * (value[i] - F.lit(means[i])) * (value[j] - F.lit(means[j]))) / F.lit(float(total)) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, entries, strict=True))
