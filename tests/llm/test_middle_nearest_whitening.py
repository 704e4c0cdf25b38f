"""Fill-in-middle, nearest neighbours and whitening on small tables, against plain versions."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.llm import fill_middle, nearest, whitening
from quillgrid.llm.queries import ORACLES, op11_fill_in_middle, op12_nearest, op13_whitening

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middle_against_lists_of_tokens(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "\n\t ", "one", " one", "one ", "a<P>b c d", "<S", "x <M> y", "<", "é ü　日本 語 \x0b🙂 z ", "a b c", "w " * 30_000]
    texts += ["".join(rng.choice("ab é🙂 \n\t<>PSM") for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id here at all", "x", 1), (3, "twice the same id", "x", 1), (3, "twice the same id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = fill_middle.restore_middle(fill_middle.fill_in_middle(df)).collect()
    key = lambda r: (r[0] is None, r[0], r[-2])
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made), key=key)
    wanted = sorted(((i, *plain_middle(i, t), t or "") for i, t, *_ in rows), key=key)
    assert got == wanted
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).collect() == []


@given(st.binary(max_size=300), st.data())
def test_rotations_turn_back(data, draw):
    a, b = sorted((draw.draw(st.integers(0, len(data))), draw.draw(st.integers(0, len(data)))))
    if any(mark in data for mark in (b"<P>", b"<S>", b"<M>")):
        return
    for form in ("psm", "spm"):
        out = bytes(fill_middle.exchange(data, a, b, form))
        p, m, s = data[:a], data[a:b], data[b:]
        assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
        assert fill_middle.restore(out, form) == data


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", 7)
    data = bytearray(range(256))
    fill_middle.rotate(data, 3, 40, 255)
    assert bytes(data) == bytes([*range(3), *range(40, 255), *range(3, 40), 255])


def test_middle_query(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    columns = sorted(op11_fill_in_middle(spark, SF).columns)
    got = sorted(tuple(r[c] for c in columns) for r in op11_fill_in_middle(spark, SF).collect())
    assert got == sorted(c.execute(f"select {', '.join(columns)} from ({ORACLES['op11_fill_in_middle']})").fetchall())


def good(v):
    return v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)


def plain_nearest(rows, queries, k):
    out = {}
    for vec_id, q in queries:
        scored = []
        own = True
        for other, v in rows:
            if own and other == vec_id and v == q:
                own = False
            elif other is not None and good(v) and len(v) == len(q):
                scored.append((-sum(np.array(v, float) * np.array(q, float)), other))
        out[vec_id] = sorted(scored)[:k]
    return out


def test_nearest_is_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, [3.0] + [0.0] * 5), (40, rows[40][1])]  # copies, an outlier, a repeated row
    rows += [(3000, None), (3001, []), (3002, [0.0] * 6), (3003, [1.0, None] + [0.0] * 4), (3004, [float("nan")] * 6), (3005, [float("inf")] * 6), (None, [1.0] * 6), (3020, [1.0, 2.0]), (3021, [2.0, 2.0]), (3040, [7.0] * 3)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "vec_id long, embedding array<float>, vector string, score double")
    queries = [(i, v) for i, v in dict((r for r in rows if r[0] is not None and r[0] % 20 == 0 and good(r[1]))).items()]
    got = {}
    found = nearest.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=20, recall=1.1, leaf_rows=8, chunk_rows=37, block_rows=5)
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    wanted = plain_nearest(rows, queries, 20)
    assert {q for q, near in wanted.items() if near} == set(got)
    for q, near in wanted.items():
        assert [(n, v) for n, v, _ in got.get(q, [])] == [(n + 1, v) for n, (_, v) in enumerate(near)]
        assert np.allclose([s for *_, s in got.get(q, [])], [-s for s, _ in near], rtol=1e-12)
    assert nearest.nearest_neighbours(df.limit(0), df.limit(0)).collect() == []


@pytest.mark.parametrize("shape", ["even", "clusters", "lengths"])
def test_nearest_recall(spark, shape):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24))
    if shape == "clusters":
        x = rng.normal(size=(60, 24))[rng.integers(60, size=3000)] + 0.2 * x
    if shape == "lengths":
        x *= np.exp(rng.normal(size=3000))[:, None]
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in nearest.nearest_neighbours(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert np.isclose(r.score, x[r.query_id] @ x[r.vec_id], rtol=1e-12)
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
        assert len(got[q]) == 20
    assert hits / (150 * 20) >= 0.9


def test_fewer_leaves_are_visited_where_vectors_cluster():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 24))[rng.integers(60, size=3000)] + 0.1 * rng.normal(size=(3000, 24))
    tree = nearest.KMeansTree(x, 16, 20)
    leaf = tree.assign(x)
    walk = next(tree.visits(x[:1], tree.leaves))
    assert sorted(walk) == list(range(tree.leaves)) and leaf[0] in walk[:3]
    top = np.argsort(-(x @ x[0]))[:20]
    assert max(walk.index(leaf[i]) for i in top) < tree.leaves / 4


def test_nearest_query(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = {}
    for r in op12_nearest(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, near in got.items():
        assert sorted(n for n, _ in near) == list(range(1, 21))
        s = x @ rows[q]
        s[ids == q] = -np.inf
        hits += len({v for _, v in near} & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def plain_whitening(rows, weights="one"):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    u, counts = np.unique([x for _, x in kept], axis=0, return_counts=True)
    w = counts if weights == "count" else np.ones(len(u), int)
    n, s = int(w.sum()), (u * w[:, None]).sum(axis=0)
    centred = u - s / n
    cov = (centred * w[:, None]).T @ centred / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    return {i: (n, int(((n * x - s) ** 2).sum()), (x - s / n) @ vectors[:, :4] / np.sqrt(e[:4])) for i, x in kept}, e / np.trace(cov)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening_against_numpy(spark, weights):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(200, 8)) * np.arange(1, 9))]
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [(700, None), (701, [None] * 8), (702, [float("nan")] * 8), (703, [float("inf")] * 8), (704, [])]
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, n int, key string")
    wanted, shares = plain_whitening([r for r in rows if r[1] != []], weights)
    got, signs = {}, {}
    for r in whitening.whiten(df, weights=weights).collect():
        n, deviation, z = wanted[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert np.isclose(abs(r.whitened), abs(z[r.component - 1]), rtol=1e-7, atol=1e-9)
        if abs(r.whitened) > 1e-6:
            assert signs.setdefault(r.component, np.sign(r.whitened * z[r.component - 1])) == np.sign(r.whitened * z[r.component - 1])
        assert np.isclose(r.explained, shares[r.component - 1], rtol=1e-9) and r.identity_error < 1e-9
        got.setdefault(r.vec_id, set()).add(r.component)
    assert set(got) == set(wanted) and all(c == {1, 2, 3, 4} for c in got.values())


def test_whitening_of_flat_long_and_mixed_vectors(spark):
    kinds = "vec_id long, embedding array<double>"
    run = lambda rows: sorted(tuple(r) for r in whitening.whiten(spark.createDataFrame(rows, kinds)).collect())
    assert run([]) == []
    assert run([(1, [0.5, 0.25]), (2, [0.5, 0.25])]) == [(i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)]
    line = run([(i, [float(i), 1.0]) for i in range(3)])
    assert [(r[0], r[1], r[2], r[3]) for r in line] == [(i, c, 3, (3 * 256 * i - 768) ** 2) for i in range(3) for c in (1, 2)]
    assert all((r[4] is None) == (r[1] == 2) and r[6] < 1e-12 for r in line)
    mixed = run([(1, [1.0]), (2, [3.0]), (3, [1.0, 1.0]), (4, [2.0, 5.0]), (5, [])])
    assert [(r[0], r[1], r[2]) for r in mixed] == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]
    huge = run([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e9, 2.0])])
    assert len(huge) == 6 and all(r[3] is None and r[2] == 3 for r in huge)


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    wanted, shares = plain_whitening(rows)
    found = op13_whitening(spark, SF)
    assert found.count() == 4 * len(wanted)
    for r in found.collect():
        n, deviation, z = wanted[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and np.isclose(abs(r.whitened), abs(z[r.component - 1]), rtol=1e-6, atol=1e-8)
        assert np.isclose(r.explained, shares[r.component - 1], rtol=1e-9) and r.identity_error <= 1e-4
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert found.where(F.col("whitened").isNull()).count() == 0
