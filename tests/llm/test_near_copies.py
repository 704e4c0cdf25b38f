"""Near copies of the pipeline's stage against brute force over five-word Jaccard indexes."""

import pytest
from test_duplicates_and_mixing import components, docs_of, near_texts, plain_fingerprint

from quillgrid.llm import near_copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("shard_rows", [512, 3])
def test_near_copies_equal_brute_force(spark, shard_rows):
    texts = near_texts()
    sets = [plain_set(t) for t in texts]
    alike = [(a, b) for b in range(len(sets)) for a in range(b) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any((plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 4 for a, b in alike)
    wanted = components(alike, range(len(sets)))
    docs = docs_of(spark, texts).union(docs_of(spark, texts).where("doc_id = 3"))
    got = near_copies.near_copy_components(docs, shard_rows=shard_rows).collect()
    assert len(got) == len(texts) + 1 and {r.doc_id: r.component_id for r in got} == wanted
    kept = near_copies.keep_first_of_near_copies(docs, shard_rows=shard_rows)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({*wanted.values()})
    assert near_copies.near_copy_components(docs.limit(0)).count() == 0


def test_a_stage_drops_an_edited_copy_beyond_four_bits(spark):
    import corpus_pipeline

    texts = near_texts()
    a, b = next((a, b) for b in range(6, len(texts)) for a in range(6, b) if len(plain_set(texts[a]) & plain_set(texts[b])) >= 0.8 * len(plain_set(texts[a]) | plain_set(texts[b])) and (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 4)
    kept = corpus_pipeline.near_dedup(spark, docs_of(spark, [texts[a], texts[b]]), "")
    assert [r.doc_id for r in kept.where("doc_id is not null").collect()] == [0]
