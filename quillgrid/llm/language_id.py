"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of the hashed character n-grams of its words; a linear layer
and a softmax give the languages. Embeddings and layer are trained together by stochastic gradient descent
in numpy on a bounded sample of labelled rows. Because the mean and the layer are linear, prediction only
counts a text's hash buckets and multiplies the counts by the buckets' logits.

A temperature fitted on held-back pieces calibrates the probabilities; a text is rejected when its best
calibrated probability is below what all but a thousandth of the rightly placed held-back pieces reach,
or below one half where that is less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import small_batches

INKED = re.compile(r"[^\W\d_]")
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
FINISH = np.uint64(0xFF51AFD7ED558CCD)
SIZES = (2, 3, 4)
PART = 1 << 20


def has_letter(text: str) -> bool:
    """Whether the text holds a character of Unicode's categories L; numerals such as \u00bd and \u2460 are none."""
    return any(m[0].isalpha() for m in INKED.finditer(text))


def grams_of(text: str, buckets: int) -> np.ndarray:
    """Hash buckets (a power of two) of all n-grams of a text's words, white space standing for a word's edge.

    An n-gram may begin or end with an edge but not reach over one.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = (c <= 32) | (c == 0x85) | (c == 0xA0) | ((c >= 0x2000) & (c <= 0x200B)) | (c == 0x2028) | (c == 0x2029) | (c == 0x3000)
    c = np.concatenate([[0], np.where(edge, 0, c)[~(edge & np.concatenate([[True], edge[:-1]]))], [0]]).astype(np.uint64)
    c, shift = (c[:-1] if c[-2] == 0 and len(c) > 2 else c), np.uint64(64 - buckets.bit_length() + 1)
    inside, found = c != 0, []
    for n in SIZES:
        m = len(c) - n + 1
        if m < 1:
            break
        h, whole = np.full(m, np.uint64(n)), np.ones(m, bool)
        for i in range(n):
            h += c[i : i + m] * SPREAD[i]
            if 0 < i < n - 1:
                whole &= inside[i : i + m]
        h ^= h >> np.uint64(31)
        found.append((h * FINISH >> shift)[whole & (inside[:m] | inside[n - 1 :])])
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def parts_of(text: str) -> Iterator[str]:
    """A text in parts of about PART characters, cut at white space where there is some."""
    start = 0
    while len(text) - start > PART:
        cut = text.rfind(" ", start + 1, start + PART)
        cut = cut if cut > 0 else start + PART
        yield text[start:cut]
        start = cut
    yield text[start:]


@dataclass
class LanguageModel:
    langs: list[str]
    logits: np.ndarray  # buckets x langs: embeddings times layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def totals(model: LanguageModel, text: str) -> np.ndarray:
    """Sum of logits over all n-grams of the text, then their number."""
    out = np.zeros(len(model.langs) + 1)
    for part in parts_of(text):
        grams = grams_of(part, len(model.logits))
        out[:-1] += np.bincount(grams, minlength=len(model.logits)) @ model.logits
        out[-1] += len(grams)
    return out


def pieces(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """n runs of 2 to 40 words at random places of a text."""
    words = text.lower().split()
    out = []
    for _ in range(n if words else 0):
        size = int(rng.integers(2, 41))
        start = int(rng.integers(0, max(1, len(words) - size + 1)))
        out.append(" ".join(words[start : start + size]))
    return out


def train(texts: list[str], labels: list[str], buckets: int = 1 << 15, dim: int = 16, epochs: int = 4, rate: float = 0.5, per_text: int = 6, seed: int = 7) -> LanguageModel:
    """Fit on pieces of the texts; every fifth text is held back for the temperature and the threshold."""
    rng, langs = np.random.default_rng(seed), sorted(set(labels))
    index = {x: i for i, x in enumerate(langs)}
    bags, y, held = [], [], []
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        for piece in pieces(text, rng, per_text):
            bags.append(grams_of(piece, buckets))
            y.append(index[label])
            held.append(i % 5 == 4)
    y, held = np.array(y, dtype=np.int64), np.array(held, dtype=bool)
    table, layer, bias = rng.normal(0, 0.1, (buckets, dim)), rng.normal(0, 0.3, (dim, len(langs))), np.zeros(len(langs))

    def batch(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(bags[r]) for r in rows])
        flat = np.concatenate([bags[r] for r in rows])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        return flat, size, np.add.reduceat(table[flat], starts, axis=0) / size[:, None]

    fit, steps = np.flatnonzero(~held), 0
    total = max(1, epochs * -(-len(fit) // 32))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // 32))):
            if not len(rows):
                continue
            flat, size, mean = batch(rows)
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            step = rate * (1 - steps / total)
            back = (p @ layer.T) / size[:, None]
            layer -= step * mean.T @ p / len(rows)
            bias -= step * p.mean(axis=0)
            np.add.at(table, flat, -step * np.repeat(back, size, axis=0))
            steps += 1
    temperature, threshold, rows = 1.0, 0.0, np.flatnonzero(held)
    if len(rows):
        z = batch(rows)[2] @ layer + bias

        def calibrated(t: float) -> np.ndarray:
            p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return p / p.sum(axis=1, keepdims=True)

        loss = lambda t: -np.log(np.maximum(calibrated(t)[np.arange(len(rows)), y[rows]], 1e-12)).mean()
        temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        best = calibrated(temperature)
        right = best.max(axis=1)[best.argmax(axis=1) == y[rows]]
        threshold = float(min(np.quantile(right, 0.001), 0.5)) if len(right) else 0.0
    return LanguageModel(langs, table @ layer, bias, temperature, threshold)


def sample_for_training(labelled: DataFrame, per_lang: int = 400, most: int = 4000, most_bytes: int = 1 << 17) -> DataFrame:
    """At most ``most`` rows (text, lang) of labelled (doc_id, text, lang), about per_lang of each language.

    Rows are drawn by a hash of doc_id, at a rate that the count of the row's language fixes. Only ids and
    languages take part in the draw; the texts meet its at most ``most`` rows by a broadcast join. Drawn
    texts above most_bytes are left out, so that the driver holds at most most * most_bytes bytes.
    """
    rows = labelled.where("text is not null and lang is not null")
    rates = rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("rate"))
    if rates.limit(10_001).count() <= 10_000:
        rates = F.broadcast(rates)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.select("doc_id", "lang").join(rates, "lang").where(draw < F.col("rate")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(drawn.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    return texts.where(F.octet_length("text") <= most_bytes).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("text", "lang")


def fit_language_model(labelled: DataFrame, per_lang: int = 400, most: int = 4000) -> LanguageModel | None:
    """Train on the driver from the bounded sample; None if no row has both text and lang."""
    sample = [(r.text, r.lang) for r in sample_for_training(labelled, per_lang, most).collect() if has_letter(r.text)]
    return train([t for t, _ in sample], [x for _, x in sample]) if sample else None


def predict(model: LanguageModel | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
    """Language, best calibrated probability and whether it is too low, for each text."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    rows = [i for i, t in enumerate(texts) if t and model and has_letter(t)]
    if rows:
        sums = np.array([totals(model, texts[i]) for i in rows])
        p = model.probabilities(sums[:, :-1], sums[:, -1])
        for i, k, s in zip(rows, p.argmax(axis=1), p.max(axis=1), strict=True):
            langs[i], scores[i] = model.langs[k], min(1.0, float(s))
    return langs, scores, [x == "und" or s < model.threshold for x, s in zip(langs, scores, strict=True)]


def identify_languages(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, lang_pred, score, rejected.

    score is the best calibrated probability. A text that is null or holds no letter is ``und`` with score
    0 and rejected, as is every text when there is no model. The whole text is used, however long. Null
    and repeated ids pass through, other columns are ignored, no rows give no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            langs, scores, rejected = predict(shipped.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of docs, with all their columns, whose text is not rejected."""
    shipped, text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rejected = predict(shipped.value, batch.column(text).to_pylist())[2]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
