"""The SimHash step of near_dedup links near copies by itself."""

from quillgrid.llm import near_copies


def test_fingerprints_link_without_bands(spark):
    """With one band of many minima nothing meets by keys; this used to find no pair."""
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base.replace("w399", "x"), base.replace("w0 ", "y "), " ".join(f"v{i}" for i in range(400)), " ".join(f"w{i}" for i in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_copies.near_copy_components(docs, bands=1, minima=2000)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]
