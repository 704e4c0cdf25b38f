"""Documents that quote a test item's question without its answer."""

import pytest

from quillgrid.llm import decontamination

QUESTION = "which river crosses the old stone bridge near the northern harbour town"
ANSWER = "the winding amber river that locals named after twelve forgotten mountain shepherds crosses it every spring"
ITEMS = [(1, f"{QUESTION}? {ANSWER}."), (2, "short question here? with some other answer of several words that nobody quotes."), (3, "a lone sentence of nine words is all one")]
TEXTS = [f"before {QUESTION} after", f"before {QUESTION}? {ANSWER}. after", f"{ANSWER}.", "x " * 3000 + QUESTION.upper() + " y" * 3000, "a short question here and no more", "which river crosses the old bridge", None]


@pytest.mark.parametrize("shard_items", [20_000, 1])
def test_a_question_alone_is_a_leak(spark, shard_items):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    benchmark = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.decontaminate(docs, benchmark, shard_items=shard_items).collect()}
    assert [i for i, r in sorted(got.items()) if r.contaminated] == [0, 1, 3]
    assert all([m.item_id for m in got[i].matches] == [1, 1] for i in (0, 1, 3))
    asked, whole = got[0].matches[0], got[1].matches[0]
    assert asked.question_overlap == 1 and asked.answer_overlap == 0 and asked.overlap < 0.8 and asked.score >= 0.6
    assert whole.question_overlap == whole.answer_overlap == whole.overlap == 1
    clean = decontamination.drop_contaminated(docs, benchmark, shard_items=shard_items)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 6]
