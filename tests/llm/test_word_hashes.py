"""Hashes of words and the search among them, against plain ones."""

import numpy as np
import xxhash

from quillgrid.llm import substring_dedup as S


def test_words_are_hashed_and_not_kept():
    """Half a million words used to be kept in each worker, at more than a fresh hash costs."""
    words = [b"a", "é".encode(), b"a", b"x" * 1000, b"\xff\x00"]
    assert S.word_hashes(words).tolist() == [xxhash.xxh64_intdigest(w, 5) for w in words]
    assert S.word_hashes([]).dtype == np.uint64 and len(S.word_hashes([])) == 0
    assert not any(isinstance(v, dict) for k, v in vars(S).items() if not k.startswith("__"))


def test_among_is_isin():
    rng = np.random.default_rng(7)
    for n, m in ((0, 0), (0, 3), (5, 0), (1, 1), (200, 7), (50, 400)):
        values, wanted = rng.integers(0, 60, n).astype(np.uint64) << np.uint64(58), rng.integers(0, 60, m).astype(np.uint64) << np.uint64(58)
        assert (S.among(values, wanted) == np.isin(values, wanted)).all()
