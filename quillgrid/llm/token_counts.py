"""Token counts: batch encoding inside Arrow functions, lengths only.

A text is cut into pieces before every single space or newline that stands between two characters that
are not white space. The byte-level pre-tokenizer ends a piece exactly there and no added token holds
white space, so the pieces' counts add up to the whole text's count. Pieces recur, so each worker keeps
the counts of short ones; unseen pieces of many documents are encoded together in batches of about
``batch_bytes`` bytes, and one text's pieces may go to several batches, so that neither a very long text
nor a run of long ones makes a large batch.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm.common import small_batches

CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_workers: dict[str, PieceCounter] = {}


def pieces_of(text: str) -> Counter:
    """Keys of a text's pieces and their numbers: the first piece after a CR, the others without their space."""
    first, *rest = text.replace("\n", " \n").split(" ")
    if text.replace("\n", " ").split(" ") != text.split():  # other white space, runs of it, or some at an end
        first, *rest = CUT.split(text)
        rest = [x[1:] if x[0] == " " else x for x in rest]
    keys = Counter(rest)
    keys["\r" + first] += 1
    return keys


def piece_of(key: str) -> str:
    return key[1:] if key[0] == "\r" else key if key[0] == "\n" else " " + key


class PieceCounter:
    """Counts tokens of pieces; keeps the counts of at most ``keep`` pieces of at most 64 characters."""

    def __init__(self, tokenizer: str, batch_bytes: int, keep: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.batch_bytes, self.keep, self.known = batch_bytes, keep, {}

    def _encode(self, keys: list[str]) -> list[int]:
        """Tokens of each piece. Pieces that begin with their cut and end in no white space are encoded as one
        text, as they would be in a document, and the tokens are dealt out by where they start."""
        out = [0] * len(keys)
        joined = [i for i, k in enumerate(keys) if k[0] != "\r" and not k[-1].isspace()]
        alone = sorted(set(range(len(keys))) - set(joined))
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([piece_of(keys[i]) for i in alone], add_special_tokens=False), strict=True):
            out[i] = len(e.ids)
        if joined:
            pieces = [piece_of(keys[i]) for i in joined]
            encoded = self.tokenizer.encode("".join(pieces), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(encoded.offsets))
            ends = np.cumsum([len(x) for x in pieces])
            counts = np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(pieces))
            for i, n in zip(joined, counts.tolist(), strict=True):
                out[i] = n
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        totals, waiting, n_waiting = [0] * len(texts), {}, 0  # waiting: piece -> [(text, times)]
        for i, text in enumerate(texts):
            if not text:
                continue
            total = 0
            for piece, times in pieces_of(text).items():
                known = self.known.get(piece)
                if known is not None:
                    total += known * times
                else:
                    if piece not in waiting:
                        waiting[piece] = []
                        n_waiting += 4 * len(piece)
                    waiting[piece].append((i, times))
                    if n_waiting >= self.batch_bytes:
                        self._settle(waiting, totals)
                        waiting, n_waiting = {}, 0
            totals[i] += total
        self._settle(waiting, totals)
        return totals

    def _settle(self, waiting: dict, totals: list[int]) -> None:
        if not waiting:
            return
        if len(self.known) > self.keep:
            self.known.clear()
        pieces = list(waiting)
        for piece, n in zip(pieces, self._encode(pieces), strict=True):
            for i, times in waiting[piece]:
                totals[i] += n * times
            if len(piece) <= 64:
                self.known[piece] = n


def counter(tokenizer: str, batch_bytes: int) -> PieceCounter:
    if tokenizer not in _workers:
        _workers[tokenizer] = PieceCounter(tokenizer, batch_bytes)
    return _workers[tokenizer]


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, batch_bytes: int = 1 << 18) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: a file name known to public_tokenizers, or a path that every executor can read. A null text
    counts as empty (0 bytes, 0 tokens); null and repeated ids pass through; other columns are ignored;
    no rows, no rows. Special strings inside a text are handled as the library does by default.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, batch_bytes).count
        for batch in small_batches(batches):
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text", "cast(coalesce(octet_length(text), 0) as long) n_bytes")
    return rows.mapInArrow(lengths, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
