"""Values in a credential's place of any length: whole spans, exact decisions, bounded work."""

import random
import time

import pytest

from quillgrid.llm import secrets


def plain_cost(value):
    """Least cost over all segmentations, by all parts at all positions and any number of parts."""
    import math

    n, spans = len(value), secrets.span_costs(value)
    best = [{} for _ in range(n + 1)]
    best[0][0, False] = 0.0
    for i in range(n):
        for (k, forced), cost in list(best[i].items()):
            steps = [(j, c, False) for j, c in spans[i]]
            total = 0.0
            for j in range(i, 0 if forced else n):
                total += secrets.brute_cost(value[j])
                steps.append((j + 1, total, True))
            for j, c, brute in steps:
                best[j][k + 1, brute] = min(cost + c, best[j].get((k + 1, brute), math.inf))
    return min(cost + math.lgamma(k + 1) / math.log(10) for (k, _), cost in best[n].items())


def random_values(n):
    rng = random.Random(12)
    pieces = [*secrets.WORDS[:20], "P@ssw0rd", "aaaa", "1111111111111", "-=-=-=-=", "qwerty", "asdf", "0123456789", "zyxwvu", "2020", "12-11-1999", "2019-05-03", "20190503", "x7qx7q", "abcd", "x", "Q7", "$", "\u0663\u0664\u0665", "\u4e00\u4e01\u4e02\u4e03", "K9v"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def test_costs_equal_all_segmentations():
    for value in [*random_values(150), "a" * 40 + "1234567" + "b" * 30, "!" * 40 + "dragon" + "=-" * 10]:
        wanted = plain_cost(value)
        assert secrets.guess_cost(value) == pytest.approx(wanted)
        for enough in (4.0, 7.0, 10.0):
            got = secrets.guess_cost(value, enough)
            assert got == pytest.approx(wanted) if wanted < enough - 1e-9 else got >= enough - 1e-9


@pytest.mark.parametrize("head", ["auth: ", "access_key=eyJ", "private_key => ", "pin: "])
def test_long_values_are_reported_and_masked_whole(spark, head):
    rng = random.Random(4)
    value = "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGH23456789+/") for _ in range(300))
    text = f"x {head}{value} tail"
    start = len("x " + head.replace("eyJ", ""))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.scan_secrets(docs).first().spans.split(",")
    assert f"guess:{start}:{len(text) - 5}" in spans
    assert secrets.redact_secrets(docs).first().text == f"{text[:start]}[secret] tail"


def test_cheap_long_values_stay_and_cost_little_time():
    start = time.process_time()
    for value in ("a" * 300_000, "password" * 13, "=-" * 100_000, "k3Q" * 200_000):  # repeats
        assert secrets.guess_spans(f"auth: {value}", 10.0) == []
    for value in ("=-k3Qz" * 50_000 + "Pq0vWx9", "-" * 100_000 + "k3QzP0vWx9", "".join(map(chr, range(0x4E00, 0x9FA5))) + "k3QzP0vWx9"):
        assert secrets.guess_spans(f"auth: {value}", 10.0) == [(6, 3, 6 + len(value))]
    assert time.process_time() - start < 20


def test_dates_blocks_and_the_words_of_the_corpus(spark):
    assert secrets.guess_cost("2019-05-03") < 5 and secrets.guess_cost("20190503") < 5
    assert secrets.guess_cost("x7qx7qx7qx7q") < secrets.guess_cost("x7qa8wb9ec4r") - 4
    assert secrets.guess_cost("password1admin2root3test4user5guest6love7") < 26
    phrase = "correcthorsebatterystaple"
    rows = [(i, "the correct horse has a battery and a staple") for i in range(40)] + [(50, f"password: {phrase}"), (51, "password: wQzXvBnMpLkJhGf"), (52, None), (53, "")] + [(60 + i, "secret: wqzxvbnmplkjhgf") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = secrets.frequent_words(docs)
    assert words[:2] == ["and", "battery"] and "horse" in words and "wqzxvbnmplkjhgf" not in words
    found = {r.doc_id: r.n_guess for r in secrets.scan_secrets(docs).collect()}
    assert (found[50], found[51], found[60], found[0], found[52]) == (0, 1, 1, 0, 0)
    assert secrets.scan_secrets(docs, words=[]).where("doc_id = 50").first().n_guess == 1
