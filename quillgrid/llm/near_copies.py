"""Near copies: candidates by SimHash and beside it banded MinHash, exact Jaccard of five-word shingles over whole texts decides.

Texts with the same set of shingles are one node. The BK-trees of simhash.py find nodes whose fingerprints are near, and
those that the exact index confirms are linked. For what they leave apart a node has one key per band, a hash of a few minima over its
shingles; nodes that reach the similarity share a key but for about one pair in 4,500, others rarely do, so the rows grow
with the documents. Within a key a pair is a candidate if sizes and SimHash fingerprints allow it.

Only components matter, so not all pairs of a key are compared, and none in a component already: in each round, the nodes of a key that are not yet
in one component with its leader are compared with it, and the verified links join components. A comparison meets two
sets of hashes in one row; a set that many pairs ask for is salted. The nodes of keys that then lie in several
components are dealt to cells of bounded rows and bytes, and cells that share a key are compared, each set sent
once a cell; only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import by_key, connected_components, discard, join_counted, join_small, light_side, materialize, small_batches
from quillgrid.llm.simhash import Forest, blocks_for, fingerprint, fingerprint_links, keep_first, signed


def shingle_hashes(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words; a text of fewer words is one run, one without words has none."""
    import xxhash

    found = (text or b"").lower().split()
    n = max(1, len(found) - words + 1) if found else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + words])) for i in range(n)), np.uint64, n))


def node_of(hashes: np.ndarray) -> int:
    import xxhash

    return signed(xxhash.xxh64_intdigest(hashes.tobytes(), 7))


def band_keys(hashes: np.ndarray, bands: int, minima: int, seed: int = 5) -> list[int]:
    """One key per band: a hash of its number and of the set's minima under as many hash functions."""
    import xxhash

    if not len(hashes):
        return []
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(1 << 63, size=bands * minima, dtype=np.uint64) for _ in range(2))
    least = np.full(bands * minima, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 2048):
        x = hashes[start : start + 2048, None] * (2 * a + 1) + b
        least = np.minimum(least, ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    return [signed(xxhash.xxh64_intdigest(least[i * minima : (i + 1) * minima].tobytes(), i)) for i in range(bands)]


def printed_texts(docs: DataFrame, words: int, shingle: int, bands: int, minima: int) -> DataFrame:
    """doc_id, node, fp, size, keys of every row of docs with a doc_id."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            out: list[list] = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text, words)
                for column, value in zip(out, (node_of(hashes), signed(fingerprint(text, shingle)), len(hashes), band_keys(hashes, bands, minima)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["doc_id", "node", "fp", "size", "keys"])

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text").where("doc_id is not null")
    return texts.mapInArrow(prints, "doc_id long, node long, fp long, size int, keys array<long>")


def hash_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, hashes (longs) of the nodes (node, doc_id: a document that has the text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            sets = [shingle_hashes(t, words) for t in batch.column(0).to_pylist()]
            found = {node: s.view(np.int64) for s, node in zip(sets, batch.column(1).to_pylist(), strict=True) if node_of(s) == node}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], ["node", "hashes"])

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    return join_small(texts, nodes, ["doc_id"]).select("text", "node").mapInArrow(hashed, "node long, hashes array<long>").dropDuplicates(["node"])


def with_sets(pairs: DataFrame, sets: DataFrame, side: str, share: int = 1000) -> DataFrame:
    """pairs with the set of the node in column side; a set that over ``share`` pairs ask for is sent to several tasks."""
    asked = materialize(pairs.groupBy(side).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / share).cast("int")), "asked")
    salted = join_counted(pairs, asked, [side]).withColumn("part", F.pmod(F.xxhash64(*pairs.columns), F.col("parts")).cast("int")).drop("parts")
    sent = sets.join(by_key(asked.drop("n")), sets["node"] == asked[side]).select(side, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("hashes").alias(f"{side}_hashes"))
    return salted.join(by_key(sent), [side, "part"]).drop("part")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least the similarity."""
    both = with_sets(with_sets(pairs, sets, "u"), sets, "v")
    shared = F.size(F.array_intersect("u_hashes", "v_hashes"))
    whole = F.size("u_hashes") + F.size("v_hashes") - shared
    return both.where(shared >= F.lit(similarity) * whole).select("u", "v")


def could_match(a: str, b: str, radius: int, similarity: float) -> F.Column:
    """Whether sizes and fingerprints of the structs a and b allow the similarity."""
    size, other = F.col(f"{a}.size"), F.col(f"{b}.size")
    near = F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius
    return near & (F.least(size, other) >= F.lit(similarity) * F.greatest(size, other))


def fingerprint_pairs(nodes: DataFrame, similarity: float, radius: int = 6) -> DataFrame:
    """Candidates (u, v) among nodes (node, fp, size): equal fingerprints by their least node, near ones by the BK-trees' spanning links."""
    classes = materialize(nodes.groupBy("fp").agg(F.min("node").alias("id"), F.count("*").alias("n")), "fingerprints")
    equal = join_counted(nodes.select("fp", "node"), classes, ["fp"]).where("node <> id").select(F.col("id").alias("u"), F.col("node").alias("v"))
    near = fingerprint_links(classes.select("fp", "id"), radius, blocks_for(classes.count(), radius))
    pairs = materialize(equal.union(near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "print-pairs")
    sizes = by_key(nodes.select(F.col("node"), F.col("size")))
    both = pairs.join(sizes.toDF("u", "a"), "u").join(sizes.toDF("v", "b"), "v")
    return materialize(both.where(F.least("a", "b") >= F.lit(similarity) * F.greatest("a", "b")).select("u", "v"), "print-pairs")


def near_copy_links(docs: DataFrame, nodes: DataFrame, radius: int, similarity: float, words: int, rounds: int, shard_rows: int) -> DataFrame:
    """Links (u, v) between nodes (node, fp, size, doc_id, keys) that join all nodes which reach the similarity."""
    members = nodes.select("node", "fp", "size", F.explode("keys").alias("key"))
    counts = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    members = materialize(join_counted(members, counts, ["key"]), "members")
    printed = fingerprint_pairs(nodes, similarity)
    asked = members.select("node").union(printed.select("u")).union(printed.select("v")).distinct()
    wanted = materialize(nodes.join(by_key(asked), "node", "left_semi").select("doc_id", "node"), "wanted")
    sets = materialize(hash_sets(docs, wanted, words), "sets")
    me = F.struct("node", "fp", "size").alias("me")
    links = materialize(verified(printed, sets, similarity), "near-links")
    open_ = members.select("key", me, F.col("node").alias("component")) if links.isEmpty() else unsettled(members, links)
    for _ in range(rounds):
        # A leader of those that the greatest component of the key does not hold, by its least name.
        leaders = materialize(open_.groupBy("key").agg(F.max(F.struct("component", F.col("me"))).alias("top"), F.count("*").alias("n")), "leaders")
        led = join_counted(open_, leaders, ["key"]).select("me", "component", F.col("top.me").alias("leader"), F.col("top.component").alias("led"))
        fits = led.where((F.col("component") != F.col("led")) & could_match("me", "leader", radius, similarity))
        pairs = materialize(fits.select(F.col("leader.node").alias("u"), F.col("me.node").alias("v")).distinct(), "pairs")
        if pairs.isEmpty():
            break
        found = verified(pairs, sets, similarity)
        links = materialize(links.union(found), "near-links")
        open_ = unsettled(members, links)
    return links.union(crossing(open_, sets, radius, similarity, shard_rows))


def unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, me, component of the keys whose nodes lie in several components so far."""
    parts = materialize(connected_components(links).withColumn("n", F.lit(1).cast("long")), "parts").drop("n")
    placed = members.join(by_key(parts), "node", "left").select("key", F.struct("node", "fp", "size").alias("me"), F.coalesce("component", "node").alias("component"))
    placed = materialize(placed, "placed")
    spread = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a <> b").select("key", "n")
    return materialize(join_counted(placed, materialize(spread, "keys"), ["key"]), "unsettled")


def cells(open_: DataFrame, cell_rows: int, cell_hashes: int) -> DataFrame:
    """node, fp, size, component, cell: nodes that share a key with the same greatest node share cells of bounded rows and hashes."""
    tops = materialize(open_.groupBy("key").agg(F.max("me.node").alias("top"), F.count("*").alias("n")), "tops")
    named = join_counted(open_, tops, ["key"]).groupBy("me", "component").agg(F.max("top").alias("cluster")).select("me.*", "component", "cluster")
    named = materialize(named, "clusters")
    parts = F.greatest(F.ceil(F.count("*") / cell_rows), F.ceil(F.sum("size") / cell_hashes)).cast("int")
    counted = materialize(named.groupBy("cluster").agg(parts.alias("parts"), F.count("*").alias("n")), "cluster-sizes")
    cell = F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("parts")))
    return materialize(join_counted(named, counted, ["cluster"]).withColumn("cell", cell).drop("cluster", "parts"), "cells")


def crossing(open_: DataFrame, sets: DataFrame, radius: int, similarity: float, cell_rows: int, cell_hashes: int = 500_000) -> DataFrame:
    """Links between nodes of a key that lie in different components, found cell against cell; no pairs but links come out."""
    placed = cells(open_, cell_rows, cell_hashes)
    held = materialize(open_.select("key", F.col("me.node").alias("node")).join(by_key(placed.select("node", "cell")), "node").select("key", "cell").distinct(), "held")
    meetings = held.withColumnRenamed("cell", "a").join(light_side(held.withColumnRenamed("cell", "b"), held.count()), "key").where("a <= b").select("a", "b").distinct()
    meetings = materialize(meetings, "meetings")
    partners = meetings.select(F.col("a").alias("cell"), "a", "b").unionByName(meetings.where("a <> b").select(F.col("b").alias("cell"), "a", "b"))
    whole = materialize(placed.join(by_key(sets), "node"), "cell-sets")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, fps, sizes, component, cell, a, b = (group.column(c).to_numpy() for c in ("node", "fp", "size", "component", "cell", "a", "b"))
        left, right = np.flatnonzero(cell == a[0]), np.flatnonzero(cell == b[0])
        bits, names = fps.view(np.uint64), np.unique(component, return_inverse=True)[1]
        hashes = group.column("hashes").combine_chunks()
        at, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        members: dict[int, frozenset] = {}
        forest, links = Forest(len(node)), []
        for i in left.tolist():
            small, large = np.minimum(sizes[right], sizes[i]), np.maximum(sizes[right], sizes[i])
            near = (np.bitwise_count(bits[right] ^ bits[i]) <= radius) & (small >= similarity * large) & (names[right] != names[i])
            for j in right[near & ((right > i) if a[0] == b[0] else True)].tolist():
                if forest.root(int(names[i])) == forest.root(int(names[j])):
                    continue
                for x in (i, j):
                    if x not in members:
                        members[x] = frozenset(values[at[x] : at[x + 1]].tolist())
                shared = len(members[i] & members[j])
                if shared >= similarity * (len(members[i]) + len(members[j]) - shared):
                    forest.join(int(names[i]), int(names[j]))
                    links.append((int(node[i]), int(node[j])))
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate(("u", "v"))})

    return whole.join(light_side(partners, meetings.count()), "cell").groupBy("a", "b").applyInArrow(compare, "u long, v long")


def near_copy_components(
    docs: DataFrame, similarity: float = 0.8, words: int = 5, radius: int = 16, shingle: int = 2, bands: int = 16, minima: int = 4, rounds: int = 1, shard_rows: int = 512
) -> DataFrame:
    """One row per row of docs (doc_id, text) with a doc_id: doc_id, component_id (the least doc_id of the component).

    Two texts are linked if the Jaccard index of their sets of ``words``-word shingles is at least
    ``similarity``, they share one of ``bands`` keys of ``minima`` minima each, and their fingerprints over shingles of
    ``shingle`` words lie within ``radius`` bits. Words are cut as in simhash_components; texts without words are copies of each other.
    """
    printed = materialize(printed_texts(docs, words, shingle, bands, minima), "prints")
    first = [F.min("fp").alias("fp"), F.min("size").alias("size"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("keys").alias("keys")]
    nodes = materialize(printed.groupBy("node").agg(*first), "nodes")
    parts = connected_components(materialize(near_copy_links(docs, nodes, radius, similarity, words, rounds, shard_rows), "near-links"))
    rooted = nodes.join(by_key(parts), "node", "left").select("node", "doc_id", "n", F.coalesce("component", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = materialize(rooted.join(by_key(least), "root").select("node", "n", "component_id"), "nodes")
    discard(nodes)
    return join_counted(printed.select("doc_id", "node"), named, ["node"]).select("doc_id", "component_id")


def keep_first_of_near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, shard_rows: int = 512) -> DataFrame:
    """The rows of docs, with all their columns, that come first (by doc_id) among their near copies.

    Rows with a null doc_id stay and link nothing; of rows that repeat a doc_id one stays.
    """
    return keep_first(docs, materialize(near_copy_components(docs, similarity, words, shard_rows=shard_rows), "near_copies"))
