"""The prediction of op10 against a plain sum over n-grams, bias, temperature, softmax and threshold."""

import math
import random

import numpy as np

from quillgrid.llm import language_id

MASK = (1 << 64) - 1


def plain_grams(text, buckets):
    """Buckets of the n-grams of each word between its edges (0); a word's edges alone are none."""
    out = []
    for word in text.lower().split():
        chars = [0, *map(ord, word), 0]
        for n in language_id.SIZES:
            for at in range(len(chars) - n + 1):
                gram = chars[at : at + n]
                if gram[0] == gram[-1] == 0:
                    continue
                h = (n + sum(c * int(s) for c, s in zip(gram, language_id.SPREAD, strict=False))) & MASK
                h ^= h >> 31
                out.append((h * int(language_id.FINISH) & MASK) >> (64 - buckets.bit_length() + 1))
    return out


def test_predictions_are_sums_over_the_whole_text(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "sea", "of", "stone"], "bb": ["der", "See", "und", "Stein"], "cc": ["la", "mer", "et", "pierre"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 60))), x) for i, x in enumerate(rng.choice(list(words)) for _ in range(300))]
    model = language_id.train([t for _, t, _ in rows], [x for *_, x in rows], buckets=1 << 10)
    texts = [t for _, t, _ in rows[:40]] + [None, "", "42 --", "the der la " * 20_000, "x", "ÉÉ ß"]
    docs = spark.createDataFrame([(i, t, "zz") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in language_id.identify_languages(docs, model).collect()}
    for i, text in enumerate(texts):
        if not text or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
            continue
        grams = plain_grams(text, len(model.logits))
        z = [(sum(float(model.logits[g][k]) for g in grams) / max(1, len(grams)) + float(model.bias[k])) / model.temperature for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        best = max(range(3), key=lambda k: e[k])  # noqa: B023
        assert got[i].lang_pred == model.langs[best] and np.isclose(got[i].score, e[best] / sum(e), rtol=1e-9)
        assert got[i].rejected == (e[best] / sum(e) < model.threshold)
