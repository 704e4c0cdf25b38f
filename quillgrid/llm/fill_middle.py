"""Fill-in-middle: a document's middle goes behind its suffix, by rotations inside one bytearray.

A text's bytes are scanned for token ends, two of which become the cuts. Sentinels are put before the three
segments and the segments change places by three-reversal rotations: ``A B`` reversed piece by piece and
then as a whole is ``B A``. Restoring finds the sentinels, turns the same rotations back and takes the
sentinels out, so a round trip needs the output and its form alone. Each text is one buffer; no copy of a
segment is made but for pieces of at most ``PIECE`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillgrid.llm.common import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PIECE = 1 << 16


def reverse(data: bytearray, start: int, stop: int) -> None:
    """Reverse data[start:stop] in place, a piece from either end at a time."""
    while stop - start > 1:
        n = min(PIECE, (stop - start) // 2)
        head = data[start : start + n]
        data[start : start + n] = data[stop - n : stop][::-1]
        data[stop - n : stop] = head[::-1]
        start, stop = start + n, stop - n


def rotate(data: bytearray, start: int, cut: int, stop: int) -> None:
    """data[start:cut] and data[cut:stop] change places."""
    reverse(data, start, cut)
    reverse(data, cut, stop)
    reverse(data, start, stop)


def token_ends(data: bytes) -> np.ndarray:
    """Byte positions behind the tokens: words with the white space before them, and white space at the end of the text."""
    at = np.frombuffer(data, np.uint8)
    space = (at == 0x20) | ((at >= 0x09) & (at <= 0x0D))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(at)) if len(at) and space[-1] else ends


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 that seed and doc_id alone settle; a null doc_id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def characters(data: bytes, start: int, stop: int) -> int:
    return int(((np.frombuffer(data, np.uint8)[start:stop] & 0xC0) != 0x80).sum())


def exchange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """text, cut at two byte positions, as psm or spm."""
    data = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        data[at:at] = mark
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(data, middle, suffix, len(data))
    if form == "spm":
        rotate(data, 0, middle, middle + len(data) - suffix)
    return data


def restore(output: bytes, form: str) -> bytes:
    """The text that exchange was given, from its output and form; a plain output is the text."""
    if form == "plain":
        return bytes(output)
    data = bytearray(output)
    if form == "spm":
        rotate(data, 0, data.index(PREFIX), data.index(MIDDLE))
    suffix, middle = data.index(SUFFIX), data.index(MIDDLE)
    rotate(data, suffix, middle, len(data))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = data.index(mark)
        del data[at : at + 3]
    return bytes(data)


def fill_in_middle(docs: DataFrame, percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n, form, prefix_chars, middle_chars, output.

    n counts the tokens of the whole text (null: empty). About ``percent`` of the documents are exchanged,
    ``spm_percent`` of these with the suffix first; the cuts, whether and how follow from seed and doc_id, so
    reruns agree and rows that repeat a doc_id are dealt with alike. A text that is empty or holds a sentinel
    stays plain, its prefix_chars and middle_chars are null and its output is the text. Segments may be
    empty. A null doc_id is drawn for as an empty one. Other columns are ignored; an empty table gives no rows.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                ends = token_ends(text)
                h1, h2, h3, h4 = draws(seed, doc_id)
                a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
                plain = not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= percent
                form = "plain" if plain else "spm" if h4 % 100 < spm_percent else "psm"
                first, second = (int(ends[k - 1]) if k else 0 for k in (a, b))
                counts.append(len(ends))
                forms.append(form)
                prefixes.append(None if plain else characters(text, 0, first))
                middles.append(None if plain else characters(text, first, second))
                outputs.append(text if plain else bytes(exchange(text, first, second, form)))
            arrays = [pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    made = rows.mapInArrow(transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", made["output"].cast("string"))


def restore_middle(made: DataFrame) -> DataFrame:
    """made (output, form and any other columns) with the column restored: the texts before fill_in_middle; null if output or form is."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            pairs = zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)
            texts = [None if output is None or form is None else restore(output.encode("utf-8", "surrogatepass") if isinstance(output, str) else output, form) for output, form in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "restored"])

    rows = made.drop("restored").withColumn("output", made["output"].cast("binary"))
    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    found = rows.mapInArrow(back, f"{told}, restored binary")
    return found.withColumn("output", found["output"].cast("string")).withColumn("restored", found["restored"].cast("string"))


#: DuckDB SQL for op11 over documents: its columns from list functions over the tokens.
MIDDLE_SQL = r"""
WITH t AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('42:' || COALESCE(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(COALESCE(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k FROM documents),
d AS (
  SELECT *, LEN(k)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (LEN(k) + 1) AS a, ('0x' || h[9:16])::BIGINT % (LEN(k) + 1) AS b,
         CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT doc_id, n, form, text, array_to_string(k[1:LEAST(a, b)], '') AS prefix,
         array_to_string(k[LEAST(a, b) + 1:GREATEST(a, b)], '') AS middle, array_to_string(k[GREATEST(a, b) + 1:], '') AS suffix FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN LENGTH(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN LENGTH(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
