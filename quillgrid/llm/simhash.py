"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees.

Equal fingerprints are one class from the start. To find fingerprints within a radius, the bits are cut
into ``blocks`` parts; two fingerprints that differ in at most ``radius`` bits agree on at least
``blocks - radius`` whole parts, so they meet in a shard keyed by some choice of that many parts and their
values. Each shard is a BK-tree (children keyed by their distance to the parent), and a search follows
only the edges within the radius of its distance. Broadcasting whole trees to all queries would compare
each fingerprint with a constant share of all others, so shards travel to their queries by key instead.

A shard emits a spanning forest of its links, never all of them. A shard above ``shard_rows`` rows is cut
into chunks, and each pair of chunks becomes a task's group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import connected_components, ids_side, join_counted, materialize, small_batches, without_ids


def fingerprint(text: str | bytes | None, shingle: int = 4) -> int:
    """SimHash of a text as an unsigned number; 0 for a text without words."""
    import xxhash

    data = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").lower()
    words = data.split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) for every row of docs (doc_id, text)."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [signed(fingerprint(x.as_py(), shingle)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").mapInArrow(prints, "doc_id long, fp long")


class BKTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            following = self.children[at].setdefault(d, new)
            if following == new:
                return
            at = following

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values at most radius away."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            open_ += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


class Forest:
    """Union-find that tells which links joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def forest_of(stored: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning links among stored values and queries (positions: stored first), queries against stored."""
    tree, forest, links = BKTree(), Forest(len(stored) + len(queries)), []
    alone = not queries
    for i, value in enumerate(stored):
        if alone:
            links += [(i, j) for j in tree.within(value, radius) if forest.join(i, j)]
        tree.insert(value)
    for i, value in enumerate(queries, len(stored)):
        links += [(i, j) for j in tree.within(value, radius) if forest.join(i, j)]
    return links


def shard_keys(fp, blocks: int, radius: int):
    """Array of shard keys of a fingerprint column: one for each choice of blocks - radius parts."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(m)).cast("long"))) for i, m in enumerate(masks)])


def fingerprint_links(classes: DataFrame, radius: int = 4, blocks: int = 6, shard_rows: int = 4096) -> DataFrame:
    """Spanning links (u, v) between the ids of classes (fp, id) whose fingerprints are within the radius.

    Two distinct shards may share a hashed key; their members are then compared too and fail on distance.
    """
    if not radius < blocks <= 64:
        raise ValueError("blocks must exceed the radius")
    members = classes.select("fp", "id", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialize(sizes.withColumn("chunks", F.ceil(F.col("n") / shard_rows).cast("int")), "shards")
    # In a shard of one chunk there is the one group (0, 0); else a row of chunk c takes part in (min(c, d), max(c, d)) for every d.
    dealt = (
        join_counted(members, sizes, ["shard"])
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("shard", "fp", "id", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(fps, ids, own, low, high):
            is_query = (own == high) & (low != high)
            order = np.concatenate([np.flatnonzero(~is_query), np.flatnonzero(is_query)])
            values = fps[order].astype(np.uint64).tolist()
            n = int((~is_query).sum())
            names = ids[order]
            return [(names[a], names[b]) for a, b in forest_of(values[:n], values[n:], radius)]

        def grouped() -> Iterator[tuple]:
            """Whole groups; rows come sorted by group, a group may span batches."""
            kept = None
            for batch in batches:
                now = [np.asarray(c) for c in batch.columns]
                now = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
                shard, _, _, _, low, high = now
                cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1
                start = 0
                for stop in cuts:
                    if stop - start > 1:
                        yield [x[start:stop] for x in now]
                    start = stop
                kept = [x[start:] for x in now]
            if kept is not None and len(kept[0]) > 1:
                yield kept

        out: list = []
        for _, fps, ids, own, low, high in grouped():
            out += settle(fps, ids, own, low[0], high[0])
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["u", "v"])

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(n, "shard", "low", "high")
        .sortWithinPartitions("shard", "low", "high")
        .select("shard", "fp", "id", "own", "low", "high")
        .mapInArrow(links, "u long, v long")
    )


def blocks_for(n: int, radius: int, most: int = 64) -> int:
    """The least number of parts, radius + 2 or more, at which n fingerprints fill a shard with ``most`` on average."""
    blocks = radius + 2
    while blocks < 64 and n > most * 2.0 ** (64 * (blocks - radius) / blocks):
        blocks += 1
    return blocks


def simhash_components(docs: DataFrame, radius: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    Words are cut at ASCII white space after lower-casing A-Z; a text of fewer words than a shingle is one
    shingle, one without words (or null) has fingerprint zero and is linked like any other. component_id is
    the smallest doc_id reachable through fingerprints at most radius bits apart. The parts (blocks) follow
    from the number of fingerprints, so that shards stay small at any size; the links do not depend on them. Rows with a null doc_id
    take part in classes but lend no id: a component of such rows alone has a null component_id. Repeated
    rows each come back; other columns are ignored; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    named = classes.select("fp", F.col("fp").alias("id"))
    blocks = blocks or blocks_for(classes.count(), radius)
    parts = connected_components(fingerprint_links(named, radius, blocks))
    joined = classes.join(parts, classes.fp == parts.node, "left").select("fp", "first_id", "n", F.coalesce("component", "fp").alias("root"))
    least = joined.where("first_id is not null").groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = materialize(joined.join(least, "root", "left").select("fp", "n", "component_id"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_counted(fps, of_class, ["fp"]).select("doc_id", hexed, "component_id")


def keep_first_of_group(docs: DataFrame, radius: int = 4, shingle: int = 4, blocks: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that come first (by doc_id) in their component.

    Rows with a null doc_id stay; of rows that repeat a doc_id one stays.
    """
    found = materialize(simhash_components(docs, radius, shingle, blocks).select("doc_id", "component_id"), "simhash")
    return keep_first(docs, found)


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names its component in found (doc_id, component_id)."""
    later = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = without_ids(docs, later)
    repeated = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    return without_ids(kept, repeated).union(kept.join(ids_side(repeated), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))
