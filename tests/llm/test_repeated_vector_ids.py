"""Different vectors under one vec_id are nodes of their own."""

from quillgrid.llm import embedding_dedup


def test_different_vectors_under_one_id(spark):
    near = lambda x, y: [1.0, x, y, 0.0]
    far = lambda x: [0.0, x, 0.0, 1.0]
    rows = [(5, near(0.0, 0.0), 1), (5, near(0.1, 0.0), 1), (7, near(0.0, 0.1), 1), (9, far(0.0), 1), (5, far(0.1), 1), (5, [0.0, 0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(df).collect())
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 1, 5, False), (5, 1, 5, True), (5, 0, 5, True)])
