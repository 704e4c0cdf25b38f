"""Substring deduplication by level-wise doubling.

The first level looks at windows of half the wanted length, and of those only at minimizers: the least
hash among the half windows inside each whole window, which any two equal whole windows share. A whole
window is looked at only where its minimizer repeats in another document; a window of twice the length
only where both of its halves repeat, and so on until no candidates survive. Whole windows settle what is
removed; the texts are not read again after that: a longer window's hash is made of its halves'.

Of documents with equal texts the first alone takes part, the others follow from it. Windows meet each
other by hash: the hashes that repeat are counted with partial sums before the shuffle and written, so that
the join that finds their documents has two plain exchanges, which Spark splits where a hash is hot.

Hashes have 64 bits, and a window is only removed when its hashes on every level repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import discard, join_counted, materialize, release_shuffles, small_batches

FACTOR, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """XXH64 (seed 5) of each word: as fast as looking a word up, and nothing is kept."""
    from xxhash import xxh64_digest

    return np.frombuffer(b"".join(map(xxh64_digest, words, repeat(5))), ">u8").astype(np.uint64)


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are wanted, by a search of each in the wanted ones (np.isin would sort the values)."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    wanted = np.sort(wanted)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of ``length`` words (numbers); fewer words have none."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(length))
    for i in range(length):
        out *= FACTOR
        out += words[i : i + n]
    return mixed(out)


def mixed(out: np.ndarray) -> np.ndarray:
    """The numbers (overwritten) with all bits spread."""
    out ^= out >> np.uint64(31)
    out *= MIX_1
    out ^= out >> np.uint64(29)
    out *= MIX_2
    return out ^ (out >> np.uint64(32))


def minimizers(words: np.ndarray, window: int, half: int) -> np.ndarray:
    """For each window the least hash of the half windows in it."""
    h = window_hashes(words, half)
    n = len(h) - (window - half)
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, window - half + 1):
        np.minimum(out, h[i : i + n], out=out)
    return out


def doubled(starts: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (ascending) and hashes of the windows of twice the length both of whose halves are given."""
    at = np.searchsorted(starts, starts + length)
    whole = starts[np.minimum(at, len(starts) - 1)] == starts + length if len(starts) else np.zeros(0, bool)
    return starts[whole], mixed(hashes[whole] * FACTOR + hashes[at[whole]])


def as_numbers(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy().astype(np.uint64) if column[i].is_valid else np.zeros(0, np.uint64)


def texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text", "xxhash64(text) part")


def copies_of(rows: DataFrame) -> DataFrame:
    """(doc_id, first_id) of the documents whose text another document has too; first_id has it first.

    Documents of several rows take no part.
    """
    digest = F.unhex(F.sha2("text", 256))
    ids = rows.where("doc_id is not null and text is not null").select("doc_id", digest.alias("digest"))
    ids = materialize(ids.groupBy("doc_id").agg(F.count("*").alias("rows"), F.first("digest").alias("digest")).where("rows = 1").drop("rows"), "digests")
    classes = ids.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    found = materialize(join_counted(ids, materialize(classes, "digests"), ["digest"]).select("doc_id", "first_id"), "copies")
    discard(ids)
    return found


def emitted(source: DataFrame, hashes_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(h, doc_id) of hashes_of(word hashes, marks) of each row of source (doc_id, text, marks)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, found, owners, waiting = batch.column(0), [], [], 0

            def rows() -> pa.RecordBatch:
                repeated = np.repeat(np.array(owners, np.int64), [len(f) for f in found])
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(repeated)], ["h", "doc_id"])

            for i in range(len(batch)):
                if not (ids[i].is_valid and batch.column(1)[i].is_valid):
                    continue
                h = np.unique(hashes_of(word_hashes(batch.column(1)[i].as_py().split()), as_numbers(batch.column(2), i)))
                if len(h):
                    found.append(h)
                    owners.append(ids[i].as_py())
                    waiting += len(h)
                if waiting > 200_000:
                    yield rows()
                    found, owners, waiting = [], [], 0
            if found:
                yield rows()

    return source.select("doc_id", "text", "marks").mapInArrow(emit, "h long, doc_id long")


def repeats_of(seen: DataFrame) -> DataFrame:
    """(h, first_id) of the hashes of seen (h, doc_id) that more than one document has."""
    counted = seen.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return materialize(counted.where("first_id < last_id").select("h", "first_id"), "repeats")


def doubling(n_words: int, window: int, deepest: int | None) -> int:
    """The longest window that a whole repeated text of n_words has; 0 for a shorter text."""
    if n_words < window:
        return 0
    while 2 * window <= n_words and (deepest is None or window < deepest):
        window *= 2
    return window


def remove_repeats(docs: DataFrame, window: int = 13, deepest: int | None = None, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, longest.

    Words are runs of anything but ASCII white space, taken unchanged from the whole text. Every word is
    removed that a window of ``window`` words covers whose words also start in a document with a smaller
    doc_id, as the input stands. kept_sha256 is the digest of the kept words, joined by one space.
    longest: the length of the longest windows, doubling from ``window`` up to at least ``deepest`` (None:
    until no candidates survive), of which the text holds one that repeats in another document; 0 for
    none. Removal is settled at the first of these lengths.

    A null text has no words. A null doc_id is neither smaller nor larger than any other: such rows keep
    their words and remove none. Rows that repeat a doc_id are one document's parts. Other columns are
    ignored; an empty table gives no rows. Later copies of a text are left out by a broadcast of at most
    broadcast_rows ids; where there are more, they pass the first level with the others.
    """
    half = (window + 1) // 2
    spark, rows = docs.sparkSession, texts(docs)
    copies = copies_of(rows)
    later = copies.where("doc_id > first_id").select("doc_id")
    few = later.limit(broadcast_rows + 1).count() <= broadcast_rows
    firsts = rows.join(F.broadcast(later), "doc_id", "left_anti") if few else rows

    seen = materialize(emitted(firsts.withColumn("marks", F.lit(None).cast("array<long>")), lambda words, _: minimizers(words, window, half)), "seen")
    repeats = repeats_of(seen)
    marks = seen.join(repeats, "h").groupBy("doc_id").agg(F.collect_list("h").alias("marks"))
    marks = materialize(marks if few else marks.join(later, "doc_id", "left_anti"), "minimizers")
    discard(seen, repeats)
    release_shuffles(spark)

    seen = materialize(emitted(firsts.join(marks, "doc_id"), lambda words, marks: window_hashes(words, window)[among(minimizers(words, window, half), marks)]), "seen")
    release_shuffles(spark)
    repeats = repeats_of(seen)
    gone = F.col("doc_id") > F.col("first_id")
    found = seen.join(repeats, "h").groupBy("doc_id").agg(F.collect_list(F.when(gone, F.col("h"))).alias("gone"), F.collect_list(F.when(~gone, F.col("h"))).alias("first"))
    info = materialize(found.join(copies.select("doc_id", (F.col("doc_id") > F.col("first_id")).alias("later")), "doc_id", "full"), "windows")
    discard(seen, repeats, marks)
    release_shuffles(spark)
    more = deepest is None or window < deepest

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list] = [[] for _ in range(6)]
            for i in range(len(batch)):
                words, later = (batch.column(2)[i].as_py() or b"").split(), batch.column(5)[i].as_py()
                gone, shared, starts, hashes = np.zeros(len(words), bool), 0, np.zeros(0, np.int64), np.zeros(0, np.uint64)
                removed, first = as_numbers(batch.column(3), i), as_numbers(batch.column(4), i)
                if len(removed) or len(first):
                    h = window_hashes(word_hashes(words), window)
                    cover = among(h, removed)
                    step = np.zeros(len(words) + 1, np.int64)
                    step[: len(cover)] += cover
                    step[window : window + len(cover)] -= cover
                    gone = np.cumsum(step[:-1]) > 0
                    at = np.flatnonzero(cover | among(h, first))
                    shared = window if len(at) else 0
                    starts, hashes = doubled(at, h[at], window) if more else (starts, hashes)
                if later is not None:
                    shared = doubling(len(words), window, deepest)
                    gone |= bool(later and shared)
                kept = list(compress(words, (~gone).tolist())) if gone.any() else words
                for column, x in zip(out, (len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), shared, starts.astype(np.int32), hashes.view(np.int64)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "part", "n_words", "n_removed", "kept_sha256", "longest", "starts", "hashes"])

    joined = rows.join(info, "doc_id", "left").select("doc_id", "part", "text", "gone", "first", "later")
    done = materialize(joined.mapInArrow(cut, "doc_id long, part long, n_words long, n_removed long, kept_sha256 string, longest long, starts array<int>, hashes array<long>"), "cut")
    release_shuffles(spark)
    level, length, reached = done.where("size(starts) > 0").select("doc_id", "part", "starts", "hashes"), 2 * window, None
    while more:
        level = extended(level, length)
        if level.isEmpty():
            break
        now = level.select("doc_id", "part", F.lit(length).cast("long").alias("deeper"))
        reached = now if reached is None else reached.union(now)
        length *= 2
        more = deepest is None or length < deepest
    result = done.select("doc_id", "part", "n_words", "n_removed", "kept_sha256", "longest")
    if reached is None:
        return result.drop("part")
    deeper = reached.groupBy("doc_id", "part").agg(F.max("deeper").alias("deeper"))
    return result.join(deeper, ["doc_id", "part"], "left").select("doc_id", "n_words", "n_removed", "kept_sha256", F.greatest("longest", F.coalesce("deeper", F.lit(0))).alias("longest"))


def extended(level: DataFrame, length: int) -> DataFrame:
    """From candidates (doc_id, part, starts, hashes) of a length, the texts in which some repeat, with the candidates of twice the length."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list] = [[], []]
            for i in range(len(batch)):
                starts, first = np.unique(batch.column(2)[i].values.to_numpy(), return_index=True)
                starts, hashes = doubled(starts.astype(np.int64), as_numbers(batch.column(3), i)[first], length)
                out[0].append(starts.astype(np.int32))
                out[1].append(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int64()))], ["doc_id", "part", "starts", "hashes"])

    seen = level.select("doc_id", "part", F.inline(F.arrays_zip("starts", "hashes")).alias("p", "h"))
    repeats = repeats_of(seen)
    kept = seen.join(repeats, "h").groupBy("doc_id", "part").agg(F.collect_list(F.struct("p", "h")).alias("at"))
    found = materialize(kept.selectExpr("doc_id", "part", "at.p starts", "at.h hashes").mapInArrow(extend, "doc_id long, part long, starts array<int>, hashes array<long>"), "doubled")
    discard(repeats)
    return found


def repeats_sql(window: int = 13, most_words: int = 200_000) -> str:
    """DuckDB SQL for remove_repeats with its default parameters over documents, by whole windows; texts of up to most_words words."""
    levels, length = [], window
    while 2 * length <= most_words:
        levels.append(f"""
l{2 * length} AS MATERIALIZED (
  SELECT a.doc_id, a.i, MD5(a.h || b.h) AS h FROM l{length} a JOIN l{length} b ON a.doc_id = b.doc_id AND b.i = a.i + {length}
  QUALIFY MIN(a.doc_id) OVER (PARTITION BY MD5(a.h || b.h)) < MAX(a.doc_id) OVER (PARTITION BY MD5(a.h || b.h))),""")
        length *= 2
    lengths = [window << k for k in range(len(levels) + 1)]
    deepest = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {n} AS n FROM l{n}" for n in lengths)
    return f"""
WITH d AS (SELECT doc_id, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(COALESCE(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
w AS (SELECT doc_id, words, UNNEST(RANGE(1, LEN(words) - {window - 2})) AS i FROM d WHERE LEN(words) >= {window}),
g AS (SELECT doc_id, i, ARRAY_TO_STRING(words[i:i + {window - 1}], ' ') AS g FROM w),
f AS (SELECT g, MIN(doc_id) AS first_id, MAX(doc_id) AS last_id FROM g GROUP BY g HAVING MIN(doc_id) < MAX(doc_id)),
l{window} AS MATERIALIZED (SELECT doc_id, i, MD5(g) AS h, first_id FROM g JOIN f USING (g)),{"".join(levels)}
r AS (SELECT doc_id, LIST(i) FILTER (WHERE doc_id > first_id) AS starts FROM l{window} GROUP BY doc_id),
c AS (SELECT doc_id, LIST_DISTINCT(FLATTEN(LIST_TRANSFORM(starts, lambda s: RANGE(s, s + {window})))) AS gone FROM r),
m AS (SELECT doc_id, MAX(n) AS longest FROM ({deepest}) GROUP BY doc_id),
k AS (
  SELECT d.doc_id, words, COALESCE(gone, []) AS gone, COALESCE(longest, 0) AS longest
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id))
SELECT doc_id, LEN(words)::BIGINT AS n_words, LEN(gone)::BIGINT AS n_removed,
       SHA256(ARRAY_TO_STRING(LIST_FILTER(words, lambda x, i: NOT LIST_CONTAINS(gone, i)), ' ')) AS kept_sha256,
       longest::BIGINT AS longest
FROM k
"""


REPEATS_SQL = repeats_sql()
