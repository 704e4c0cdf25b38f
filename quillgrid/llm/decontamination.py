"""Benchmark decontamination: a BM25 index of test items, searched with every passage of every document.

A posting's weight is its BM25 impact divided by the item's own total, so a passage's score for an item is
the share of the item's BM25 mass that the passage's terms cover, and one threshold serves all items.
Postings lie in blocks with their greatest weight; block-max WAND retrieves all items above the threshold
and skips blocks that cannot reach it. Passages overlap so that each run of words as long as the longest
item lies whole in one of them. A vectorised bound over the rarer terms (those whose complement cannot
alone reach the threshold) first discards the passages that hold no item above it; no item is lost.
An item's question is a unit of the index beside the whole item, so that the threshold holds for each alone.
What is retrieved is then verified by shingles of five words: the whole item's or its question's decide, the
answer's are reported beside them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import materialize, small_batches

TERM = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
MATCH = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("overlap", pa.float64())])


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


@dataclass
class Item:
    item_id: int
    words: list[str]
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)
    whole: set = field(default_factory=set)
    answer_words: int = 0  # 0 if the answer is not a part of its own
    asked: bool = False  # the unit is the item's question alone


def read_item(item_id: int, text: str, size: int) -> Item:
    """The answer is the last sentence, the question all before it; a lone sentence is both."""
    sentences = [s for s in SENTENCE_END.split(text) if TERM.search(s)]
    words = terms_of(text)
    question, answer = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)
    own = len(terms_of(answer)) if len(sentences) > 1 else 0
    return Item(item_id, words, shingles(terms_of(question), size), shingles(terms_of(answer), size), shingles(words, size), own)


def units_of(items: list[Item], least: int) -> list[Item]:
    """The items, and after them the question of each item whose question is a part of it with at least ``least`` words."""
    asked = []
    for x in items:
        n = len(x.words) - x.answer_words
        if x.answer_words and n >= least:
            asked.append(Item(x.item_id, x.words[:n], x.question, x.answer, x.whole, asked=True))
    return [*items, *asked]


class BlockMaxIndex:
    """Postings of items by term, in blocks of ``block`` postings with their last item and greatest weight.

    Items may hold units of units_of; whole items alone make the document frequencies and the mean length.
    """

    def __init__(self, items: list[Item], threshold: float, block: int = 64, k1: float = 1.2, b: float = 0.75):
        self.items, self.threshold, self.block = items, threshold, block
        places = {id(x.whole): i for i, x in enumerate(items) if not x.asked}  # a question shares its item's set of shingles
        self.whole_of = [places[id(x.whole)] for x in items]
        counts = [Counter(x.words) for x in items]
        df = Counter(t for x, c in zip(items, counts, strict=True) if not x.asked for t in c)
        wholes = [x for x in items if not x.asked]
        mean = sum(len(x.words) for x in wholes) / max(1, len(wholes))
        idf = {t: math.log(1 + (len(wholes) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        postings: dict[str, list[tuple[int, float]]] = {t: [] for t in df}
        for i, c in enumerate(counts):
            norm = k1 * (1 - b + b * len(items[i].words) / max(mean, 1e-9))
            impact = {t: idf[t] * n * (k1 + 1) / (n + norm) for t, n in c.items()}
            total = sum(impact.values())
            for t, x in impact.items():
                postings[t].append((i, x / total))
        self.ids = {t: [i for i, _ in p] for t, p in postings.items()}
        self.weights = {t: [w for _, w in p] for t, p in postings.items()}
        self.upper = {t: max(w) for t, w in self.weights.items()}
        self.blocks = {t: [(p[min(i + block, len(p)) - 1][0], max(w for _, w in p[i : i + block])) for i in range(0, len(p), block)] for t, p in postings.items()}
        self.span = max((len(x.words) for x in items), default=1) or 1
        self._split_terms(df)

    def _split_terms(self, df: Counter) -> None:
        """Common terms, frequent first, as long as no item gets more than 0.4 of the threshold from them alone."""
        rest = np.zeros(len(self.items))
        common = set()
        for t in sorted(df, key=lambda t: (-df[t], t)):
            more = rest.copy()
            more[self.ids[t]] += self.weights[t]
            if more.max(initial=0) > 0.4 * self.threshold:
                break
            rest = more
            common.add(t)
        rare = [t for t in df if t not in common]
        self.rest = rest
        self.rare = {t: i for i, t in enumerate(rare)}
        self.starts = np.concatenate([[0], np.cumsum([len(self.ids[t]) for t in rare])]).astype(np.int64)
        self.rare_items = np.array([i for t in rare for i in self.ids[t]], np.int64)
        self.rare_weights = np.array([w for t in rare for w in self.weights[t]])

    def passages(self, words: list[str]) -> list[int]:
        """Numbers of the passages (two neighbouring spans) in which some item may reach the threshold."""
        get = self.rare.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        n, hits = len(self.items), np.unique(at // self.span * len(self.rare) + ids[at])  # a term counts once in a span
        ids, spans = hits % len(self.rare), hits // len(self.rare)
        sizes = self.starts[ids + 1] - self.starts[ids]
        flat = np.repeat(self.starts[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        keys, weights = np.repeat(spans, sizes) * n + self.rare_items[flat], self.rare_weights[flat]
        keys, back = np.unique(keys, return_inverse=True)
        sums = np.bincount(back, weights=weights)
        following = np.searchsorted(keys, keys + n)
        both = sums + np.where((following < len(keys)) & (keys[np.minimum(following, len(keys) - 1)] == keys + n), sums[np.minimum(following, len(keys) - 1)], 0)
        # A passage whose hits all lie in its second span is found from the span before.
        enough = both + self.rest[keys % n] >= self.threshold - 1e-9
        late = sums + self.rest[keys % n] >= self.threshold - 1e-9
        return sorted({*(keys[enough] // n).tolist(), *(np.maximum(keys[late] // n - 1, 0)).tolist()})

    def search(self, terms: set[str]) -> list[tuple[int, float]]:
        """(item, score) of all items whose score reaches the threshold, by block-max WAND."""
        least, found = self.threshold - 1e-9, []
        cursors = [[self.ids[t][0], t, 0] for t in terms if t in self.ids]  # item, term, position
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                bound += self.upper[c[1]]
                if bound >= least:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, limit = 0.0, math.inf if pivot + 1 == len(cursors) else cursors[pivot + 1][0]
            for c in cursors[: pivot + 1]:
                blocks = self.blocks[c[1]]
                k = c[2] // self.block
                while k < len(blocks) and blocks[k][0] < item:
                    k += 1
                if k < len(blocks):
                    bound += blocks[k][1]
                    limit = min(limit, blocks[k][0] + 1)
            if bound < least:
                cursors = self._advance(cursors, pivot, max(item + 1, limit) if limit < math.inf else item + 1)
            elif cursors[0][0] == item:
                score = sum(self.weights[c[1]][c[2]] for c in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                cursors = self._advance(cursors, pivot, item + 1)
            else:
                cursors = self._advance(cursors, pivot, item)
        return found

    def _advance(self, cursors: list, pivot: int, item: int) -> list:
        """Move the first pivot + 1 cursors to their first posting at or after item; ended ones go."""
        kept = []
        for n, c in enumerate(cursors):
            if n <= pivot and c[0] < item:
                ids = self.ids[c[1]]
                c[2] = bisect_left(ids, item, c[2])
                if c[2] == len(ids):
                    continue
                c[0] = ids[c[2]]
            kept.append(c)
        return kept

    def matches(self, text: str | None, size: int, overlap: float) -> list[dict]:
        """One entry per item that a passage of the text covers, whole or by its question: score and overlaps of its best passage."""
        words, best = terms_of(text), {}
        for p in self.passages(words) if words else []:
            passage = words[p * self.span : (p + 2) * self.span]
            retrieved = self.search(set(passage))
            if not retrieved:
                continue
            by_size: dict[int, set] = {}
            for i, score in retrieved:
                item = self.items[i]
                n = min(size, len(item.words))
                have = by_size.setdefault(n, shingles(passage, n))
                share = lambda of: sum(s in have or (len(s) < n and contains(passage, s)) for s in of) / len(of)  # noqa: B023, E731
                found = dict(item_id=item.item_id, score=score, question_overlap=share(item.question), answer_overlap=share(item.answer), overlap=share(item.whole))
                if found["question_overlap" if item.asked else "overlap"] >= overlap:
                    # Whole items come first; repeated items stay apart by the place of their whole.
                    k = self.whole_of[i]
                    rank = lambda x: (x["overlap"], x["question_overlap"])
                    if k not in best or rank(found) > rank(best[k]):
                        best[k] = found
        return [best[k] for k in sorted(best, key=lambda k: self.items[k].item_id)]


def contains(words: list[str], run: tuple[str, ...]) -> bool:
    n = len(run)
    return any(tuple(words[i : i + n]) == run for i in range(len(words) - n + 1))


def item_shards(benchmark: DataFrame, shard_items: int, shard_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in shards of bounded size: as many as keep each below both bounds on average."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "text").where("item_id is not null and text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-n // shard_items), -(-size // shard_bytes))
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).orderBy("item_id", "text").collect()
        yield [(r.item_id, r.text) for r in rows]


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, size: int = 5, shard_items: int = 20_000, shard_bytes: int = 1 << 25, question_words: int = 8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, contaminated, matches (item_id, score, overlaps).

    A document is contaminated when a passage reaches ``threshold`` of an item's BM25 mass and holds at
    least ``overlap`` of its shingles of ``size`` lower-case words (an item of fewer words is one shingle), or
    when the same holds of the item's question (all but its last sentence, ``question_words`` words or more).
    The index is broadcast; items beyond shard_items or shard_bytes make further shards, and each document
    then passes one shard after the other, with its rows written between, so that one index is held at a time. Null items, items without words, null and empty texts match
    nothing; repeated items match each; null and repeated doc_ids pass through; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text", "cast(array() as array<struct<item_id: long, score: double, question_overlap: double, answer_overlap: double, overlap: double>>) matches")

    def search_with(shipped):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in small_batches(batches):
                found = [before + index.matches(text, size, overlap) for text, before in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(MATCH))], ["doc_id", "text", "matches"])

        return search

    held = None
    for shard in item_shards(benchmark, shard_items, shard_bytes):
        items = [item for i, text in shard if (item := read_item(i, text, size)).words]
        if items:
            if held is not None:
                rows = materialize(rows, "searched")
                held.destroy()
            held = sc.broadcast(BlockMaxIndex(units_of(items, question_words), threshold))
            rows = rows.mapInArrow(search_with(held), rows.schema)
    return rows.select("doc_id", (F.size("matches") > 0).alias("contaminated"), "matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, size: int = 5, shard_items: int = 20_000, shard_bytes: int = 1 << 25, question_words: int = 8) -> DataFrame:
    """The rows of docs, with all their columns, that hold no test item in the sense of decontaminate."""
    sc, text, rows = docs.sparkSession.sparkContext, docs.columns.index("text"), docs

    def clean_by(shipped):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                yield batch.filter(pa.array([not shipped.value.matches(t, size, overlap) for t in batch.column(text).to_pylist()], pa.bool_()))

        return clean

    held = None
    for shard in item_shards(benchmark, shard_items, shard_bytes):
        items = [item for i, t in shard if (item := read_item(i, t, size)).words]
        if items:
            if held is not None:
                rows = materialize(rows, "clean")
                held.destroy()
            held = sc.broadcast(BlockMaxIndex(units_of(items, question_words), threshold))
            rows = rows.mapInArrow(clean_by(held), docs.schema)
    return rows
