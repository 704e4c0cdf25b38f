"""Quality classifier by hierarchical empirical Bayes.

A logistic classifier over hashed words and text statistics, fitted on a bounded sample of labelled rows,
gives each document a probability. Grouped sums of these probabilities give every host and every path of a
host a posterior quality: a path is shrunk toward its host and a host toward the whole corpus, by prior
strengths that the spread between sites fixes (method of moments). A document's score combines its own
evidence with the posterior of its path, in which its own evidence does not count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import join_small, materialize, small_batches

N_STATISTICS = 10
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SPACE, INK = re.compile(rb"\s"), re.compile(rb"\S")
UPPER, DIGITS, SPACES = slice(65, 91), slice(48, 58), [9, 10, 11, 12, 13, 32]


class Buckets(dict):
    """Hash bucket of each word met."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = b = zlib.crc32(word) % self.n
        return b


_buckets: dict[int, Buckets] = {}


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in slices of about size bytes that end at white space, so that a long text is never split into words at once."""
    start = 0
    while start < len(text):
        found = SPACE.search(text, start + size)
        end = found.start() if found else len(text)
        yield text[start:end]
        start = end


def features(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, then the buckets of the text's words and their square-root frequencies at length 1."""
    n, same, last, counts, octets = 0, 0, None, Counter(), np.zeros(256, np.int64)
    for piece in pieces(text):
        words = piece.split()
        counts.update(words)
        octets += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        same += sum(a == b for a, b in zip(words, words[1:], strict=False)) + bool(words and words[0] == last)
        n, last = n + len(words), words[-1] if words else last
    inked = max(1, int(octets.sum() - octets[SPACES].sum()))
    letters, upper, digits = int(octets[LETTERS].sum()), int(octets[UPPER].sum()), int(octets[DIGITS].sum())
    repeats = same / max(1, n - 1)
    lines = [x for x in text.split(b"\n") if x]
    statistics = np.array([
        np.log1p(n), len(counts) / max(1, n), repeats, upper / max(1, letters), digits / inked, (inked - letters - digits) / inked,
        np.log1p(inked / max(1, n)), len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / max(1, n), np.log1p(n / max(1, len(lines))),
    ])
    known = _buckets.setdefault(buckets, Buckets(buckets))
    at = np.fromiter((known[w.lower()] for w in counts), np.int64, len(counts))
    value = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)) / max(1, n))
    return statistics, at, value


@dataclass
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    statistics: np.ndarray
    words: np.ndarray
    bias: float

    def logit(self, text: bytes) -> float:
        s, at, value = features(text, len(self.words))
        return float(np.clip((s - self.mean) / self.spread, -6, 6) @ self.statistics + self.words[at] @ value + self.bias)


def train(texts: list[bytes], labels: list[int], buckets: int = 1 << 14, epochs: int = 12, rate: float = 0.3, l2: float = 1e-5, seed: int = 3) -> QualityModel:
    rng = np.random.default_rng(seed)
    made = [features(t, buckets) for t in texts]
    s = np.array([m[0] for m in made]).reshape(len(made), N_STATISTICS)
    mean, spread = s.mean(axis=0), s.std(axis=0) + 1e-6
    s, y = np.clip((s - mean) / spread, -6, 6), np.array(labels, np.float64)
    a, b, bias, step = np.zeros(N_STATISTICS), np.zeros(buckets), 0.0, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(made)), max(1, len(made) // 32)):
            at, sizes = np.concatenate([made[r][1] for r in rows]), [len(made[r][1]) for r in rows]
            value, owner = np.concatenate([made[r][2] for r in rows]), np.repeat(np.arange(len(rows)), sizes)
            z = s[rows] @ a + np.bincount(owner, weights=b[at] * value, minlength=len(rows)) + bias
            error = 1 / (1 + np.exp(-z)) - y[rows]
            pace = rate / (1 + step / 400)
            a -= pace * (error @ s[rows] / len(rows) + l2 * a)
            np.add.at(b, at, -pace * error[owner] * value / len(rows))
            bias -= pace * error.mean()
            step += 1
    return QualityModel(mean, spread, a, b, float(bias))


def fit_quality_model(docs: DataFrame, labels: DataFrame, most: int = 6000, most_bytes: int = 1 << 17) -> QualityModel | None:
    """Fit on at most ``most`` rows of docs that have a label 0 or 1, drawn by a hash of doc_id; None without labels.

    Drawn texts above most_bytes are left out, so that the driver holds at most most * most_bytes bytes.
    """
    labelled = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    rows = docs.where("text is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    # Ids alone take part in the draw; the texts meet its at most ``most`` rows by a broadcast join.
    drawn = rows.select("doc_id").join(labelled, "doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("quality sample")), "doc_id").limit(most)
    sample = rows.join(F.broadcast(drawn), "doc_id").where(F.octet_length("text") <= most_bytes).orderBy("doc_id").limit(most).collect()
    sample = [(bytes(r.text), r.quality) for r in sample if r.text.split()]
    return train([t for t, _ in sample], [q for _, q in sample]) if sample else None


def document_evidence(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, host, path and p, the classifier's probability; p is null for a text without words."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in small_batches(batches):
            out = []
            for x in batch.column(3):
                text = x.as_py()
                words = bool(text and INK.search(text))
                out.append(None if not words else 0.5 if model is None else float(1 / (1 + np.exp(-np.clip(model.logit(text), -12, 12)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.float64())], ["doc_id", "host", "path", "p"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "host", "path", "cast(text as binary) text")
    return rows.mapInArrow(score, "doc_id long, host string, path string, p double")


def strength(groups: DataFrame, mean: float) -> float:
    """Prior strength of groups (n, s): what a beta prior with the variance between the groups' means would hold."""
    row = groups.where("n >= 2").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.expr(f"n * pow(s / n - {mean!r}D, 2)")).alias("between"), F.sum(F.expr("pow(n, 2)")).alias("squares")
    ).first()
    if not row.n or row.k < 2 or not 0 < mean < 1:
        return 10.0
    inside = mean * (1 - mean)
    scale = row.n - row.squares / row.n
    variance = max((row.between - (row.k - 1) * inside) / max(scale, 1e-9), inside * 1e-4)
    return float(min(max(inside / variance - 1, 1.0), 1e4))


def score_quality(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5, most: int = 6000, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per row of docs (doc_id, text, host, path): doc_id, host, path, doc_score, host_score, path_score, score, kept.

    host_score and path_score are the posteriors of the site without this row. A text without words has a
    null doc_score, lends its site no evidence, scores 0 and isn't kept. A null host or path stands for no
    site: its rows fall back on the corpus or the host. Without any label every text is taken as even
    (0.5). Up to broadcast_rows sites are broadcast, more are joined by salted
    keys. Null and repeated ids pass through, other columns are ignored, an empty table gives no rows.
    """
    evidence = materialize(document_evidence(docs, fit_quality_model(docs, labels, most)), "evidence")
    paths = evidence.where("p is not null").groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    overall = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = float(min(max(overall.s / overall.n, 1e-4), 1 - 1e-4)) if overall.n else 0.5
    k_host, k_path = strength(hosts.where("host is not null"), mean), strength(paths.where("path is not null"), mean)
    sites = paths.where("path is not null and host is not null").withColumnRenamed("n", "path_n").withColumnRenamed("s", "path_s")
    hosts = hosts.where("host is not null").withColumnRenamed("n", "host_n").withColumnRenamed("s", "host_s")
    one, own = F.col("p").isNotNull().cast("int"), F.coalesce("p", F.lit(0.0))
    without = lambda c, x: F.greatest(F.coalesce(F.col(c), F.lit(0)) - F.when(F.col(c).isNotNull(), x).otherwise(0), F.lit(0))
    logit = lambda x: F.log(F.greatest(x, F.lit(1e-6)) / F.greatest(1 - x, F.lit(1e-6)))
    joined = join_small(join_small(evidence, sites, ["host", "path"], "left", broadcast_rows), hosts, ["host"], "left", broadcast_rows)
    scored = joined.withColumn("host_score", (without("host_s", own) + k_host * mean) / (without("host_n", one) + k_host)).withColumn(
        "path_score", (without("path_s", own) + k_path * F.col("host_score")) / (without("path_n", one) + k_path)
    )
    score = 1 / (1 + F.exp(-(logit(F.col("p")) + logit(F.col("path_score")) - logit(F.lit(mean)))))
    scored = scored.withColumn("score", F.when(F.col("p").isNull(), 0.0).otherwise(score))
    return scored.select("doc_id", "host", "path", F.col("p").alias("doc_score"), "host_score", "path_score", "score", (F.col("score") >= keep_at).alias("kept"))
