"""Deduplication, decontamination, mixing and the pipeline on small tables, against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgrid.llm import decontamination, embedding_dedup, mixing, simhash
from quillgrid.llm.common import connected_components, join_small, without_ids
from quillgrid.llm.substring_dedup import remove_repeats

DOCS = "doc_id long, text string, source string, component_id string, size int, taken string"


def docs_of(spark, texts, sources=None):
    rows = [(i, t, (sources or ["s"])[i % len(sources or ["s"])], "x", 1, "y") for i, t in enumerate(texts)]
    rows += [(None, "a null id", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def components(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_connected_components(spark, shape):
    rng = random.Random(5)
    edges = {"random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 30)] + [(7, 7), (None, 3)], "none": []}[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components(real, {n for e in real for n in e})


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for bit in range(64):
            counts[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * counts[bit] > len(grams))


def near_texts(n=40):
    rng = random.Random(3)
    words = [f"w{i}é" for i in range(300)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(6)]
    out = ["", None, " \n\t", "one two", "ONE Two", "x " * 20_000]
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    return [*out, out[-1], out[-1]]


def test_fingerprint_equals_definition_and_sparks_hash(spark):
    for text in ["", "a", "A b C d e F", "é ß\x0b漢 x", "a\tb\nc  d e", "z " * 70_000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert spark.sql("select xxhash64('a b c d')").first()[0] == simhash.signed(xxhash.xxh64_intdigest(b"a b c d", 42))


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:60]]
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in values[:80]:
        assert sorted(tree.within(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_simhash_components_equal_brute_force(spark, shard_rows, monkeypatch):
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda classes, radius, blocks: links(classes, radius, blocks, shard_rows))
    texts = near_texts()
    got = simhash.simhash_components(docs_of(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    wanted = components([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", wanted[r.doc_id])


def test_simhash_keeps_one_of_each_group(spark):
    texts = near_texts(20)
    docs = docs_of(spark, texts).union(docs_of(spark, texts).where("doc_id = 3"))
    kept = simhash.keep_first_of_group(docs)
    found = simhash.simhash_components(docs).where("doc_id is not null").select("component_id").distinct().count()
    assert kept.columns == docs.columns
    assert kept.where("doc_id is not null").count() == found and kept.where("doc_id is null").count() == 2
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def plain_removal(texts, window=13):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def repeat_texts():
    rng = random.Random(11)
    words = [f"v{i}" for i in range(40)] + ["é", "漢\x1cx", "\xa0"]
    passage = [rng.choice(words) for _ in range(60)]
    out = ["", None, "one two three", " ".join(passage[:12]), " ".join(passage[:13]), "a " * 40, "a " * 30, "b " * 12]
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        lo = rng.randrange(40)
        text[rng.randrange(len(text)) : 0] = passage[lo : lo + rng.randrange(5, 30)]
        out.append(("\n" if rng.random() < 0.3 else " ").join(text))
    return [*out, out[-1], out[-2], "q " + " ".join(passage) + " " + " ".join(passage), "r " + " ".join(passage) + " s"]


@pytest.mark.parametrize("deepest", [13, None])
def test_substring_dedup_equals_brute_force(spark, deepest):
    texts = dict(enumerate(repeat_texts()))
    got = remove_repeats(docs_of(spark, list(texts.values())), deepest=deepest).collect()
    assert len(got) == len(texts) + 2
    wanted = plain_removal(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None} == wanted
    longest = plain_longest(texts)
    assert {r.doc_id: r.longest for r in got if r.doc_id is not None} == (longest if deepest is None else {i: min(n, 13) for i, n in longest.items()})
    assert deepest or max(longest.values()) > 26


def plain_longest(texts, window=13):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    out = dict.fromkeys(texts, 0)
    while any(len(w) >= window for w in words.values()):
        owners = defaultdict(set)
        for i, w in words.items():
            for k in range(len(w) - window + 1):
                owners[tuple(w[k : k + window])].add(i)
        for found in owners.values():
            if len(found) > 1:
                out.update(dict.fromkeys(found, window))
        window *= 2
    return out


def test_substring_dedup_without_a_broadcast_of_copies(spark):
    texts = dict(enumerate(repeat_texts()))
    got = remove_repeats(docs_of(spark, list(texts.values())), broadcast_rows=0).where("doc_id is not null").collect()
    removed, longest = plain_removal(texts), plain_longest(texts)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.longest) for r in got} == {i: (*removed[i], longest[i]) for i in texts}


def test_substring_dedup_edges(spark):
    assert remove_repeats(docs_of(spark, []).limit(0)).count() == 0
    text = " ".join(map(str, range(20)))
    rows = [(1, text), (1, text), (None, text), (2, text)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 20)]


def leak_tables(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 30))) + ". " + " ".join(rng.choice(words) for _ in range(6)) + "." for _ in range(30)]
    texts = ["", None, "short", items[3], items[4].upper(), "x " * 30_000 + items[5] + " y" * 500]
    for _ in range(20):
        body = [rng.choice(words) for _ in range(rng.randrange(10, 200))]
        at = rng.randrange(len(body))
        share = rng.choice(["none", "whole", "half"])
        item = rng.choice(items).split()
        texts.append(" ".join(body[:at] + {"none": [], "whole": item, "half": item[: len(item) // 2]}[share] + body[at:]))
    rows = [(i, t) for i, t in enumerate(items)] + [(100, None), (101, ""), (102, "one two"), (None, "lost"), (3, items[3])]
    return texts, items, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("shard_items", [20_000, 7])
def test_decontamination_equals_brute_force(spark, shard_items):
    texts, items, benchmark = leak_tables(spark)
    docs = docs_of(spark, [*texts, "zero one two three"])
    got = decontamination.decontaminate(docs, benchmark, shard_items=shard_items).collect()
    assert len(got) == len(texts) + 3
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    shingles = {i: decontamination.shingles(decontamination.terms_of(t), 5) for i, t in enumerate(items)}
    for i, t in enumerate(texts):
        have = decontamination.shingles(decontamination.terms_of(t), 5)
        wanted = {k for k, s in shingles.items() if len(s & have) >= 0.8 * len(s)}
        assert {m.item_id for m in by_id[i].matches} == wanted and by_id[i].contaminated == bool(wanted)
    assert [m.item_id for m in by_id[len(texts)].matches] == [102]
    clean = decontamination.drop_contaminated(docs, benchmark, shard_items=shard_items)
    assert clean.columns == docs.columns and clean.count() == sum(not r.contaminated for r in got)
    assert decontamination.decontaminate(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.decontaminate(docs.limit(0), benchmark).count() == 0


def test_block_max_wand_equals_exhaustive_scores():
    rng = random.Random(6)
    words = [f"t{i}" for i in range(60)]
    items = [decontamination.read_item(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 15))), 5) for i in range(200)]
    for threshold in (0.3, 0.6):
        index = decontamination.BlockMaxIndex(items, threshold, block=8)
        for _ in range(60):
            terms = set(rng.sample(words, rng.randrange(1, 30)))
            score = defaultdict(float)
            for t in terms & index.ids.keys():
                for i, w in zip(index.ids[t], index.weights[t], strict=True):
                    score[i] += w
            got = dict(index.search(terms))
            assert got.keys() == {i for i, s in score.items() if s >= threshold - 1e-9}
            assert all(got[i] == pytest.approx(score[i]) for i in got)


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(120):
        x = base[i % 12] + rng.normal(size=16) * (0.05 + 0.35 * (i % 3)) if i % 4 else rng.normal(size=16)
        rows.append((i, [float(v) for v in x.astype(np.float32)], i % 2))
    rows += [(200, rows[1][1], 1), (201, rows[1][1], 1), (202, [2 * v for v in rows[1][1]], 1), (203, rows[1][1], None), (204, None, 1), (205, [0.0] * 16, 1), (206, [float("nan")] * 16, 1), (207, [1.0, None] * 8, 1), (208, [], 1), (209, rows[1][1][:8], 1), (None, rows[1][1], 1), (210, [0.0, 1.0] * 8, 0), (211, [-0.0, 1.0] * 8, 0)]
    return rows, spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")


@pytest.mark.parametrize("chunk_rows", [4000, 5])
def test_embedding_components_equal_brute_force(spark, chunk_rows):
    rows, df = vectors(spark)
    fine = {i: (np.array(v, np.float32).astype(np.float64), lab) for i, v, lab in rows if i is not None and v and lab is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0}
    edges = [(a, b) for a, (x, p) in fine.items() for b, (y, q) in fine.items() if a < b and p == q and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93]
    wanted = components(edges, [r[0] for r in rows if r[0] is not None])
    links = Counter(n for e in edges for n in e)
    got = embedding_dedup.embedding_components(df, chunk_rows=chunk_rows).collect()
    assert len(got) == len(rows) and links
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], wanted[r.vec_id], wanted[r.vec_id] == r.vec_id)


def test_embedding_edges(spark):
    _, df = vectors(spark)
    assert embedding_dedup.embedding_components(df.limit(0)).count() == 0
    wide = df.where("vec_id in (1, 200)").withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert embedding_dedup.embedding_components(wide).where("n_links = 1").count() == 2


def test_mixing_equals_sql(spark):
    rng = random.Random(8)
    texts = [" ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)] + [None, "", "w " * 40_000]
    docs = docs_of(spark, texts, ["a", "a", "a", "b", None, "z", "é"]).union(docs_of(spark, texts[:3]))
    got = mixing.mix_sources(docs)
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.source or "", r.size, r.source_size, r.target, r.taken) for r in got.collect())
    mixed = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841  DuckDB reads it by name
    sql = duckdb.sql(f"SELECT COALESCE(doc_id, -1), COALESCE(source, ''), size, source_size, target, taken FROM ({mixing.MIX_SQL.format(docs='mixed')})").fetchall()
    assert rows == sorted(sql)
    total = sum(r[2] for r in rows)
    taken, target = Counter(), {}
    for _, s, size, _, goal, n in rows:
        taken[s] += n
        target[s] = goal
        assert 0 <= n <= 3 * size
    assert all(taken[s] == int(target[s]) for s in target) and sum(target.values()) == pytest.approx(total)


def water_fill(sizes, weights, limit=3):
    target, open_ = {}, set(sizes)
    total = sum(sizes.values())
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(limit * sizes[s])
            open_.discard(s)
    return target


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(1)
    for _ in range(3):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 20_000]) for i in range(9)}
        df = spark.createDataFrame([(k, k, v) for k, v in sizes.items()], "src string, source string, source_size long")
        got = {r.src: r.target for r in mixing.source_targets(df, (1, 2, 3), 3).collect()}
        assert got == pytest.approx(water_fill(sizes, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}))


def test_mixing_edges(spark):
    assert mixing.mix_sources(docs_of(spark, []).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_sources(docs_of(spark, ["", None])).where("doc_id is not null").collect()] == [0, 0]


def test_without_ids_by_either_way(spark):
    docs = docs_of(spark, ["a", "b", "c"])
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    for most in (0, 10):
        assert sorted(r.doc_id for r in without_ids(docs, ids, most).collect() if r.doc_id is not None) == [0]


def test_join_small_by_either_way(spark):
    docs = docs_of(spark, ["a", "b", "c"], ["s", "t", "u"])
    few = spark.createDataFrame([("s", 1), ("t", 2)], "source string, v int")
    for most in (0, 10):
        got = join_small(docs, few, ["source"], "left", most, 3)
        assert {r.doc_id: r.v for r in got.collect() if r.doc_id is not None} == {0: 1, 1: 2, 2: None}
        assert got.count() == 5


def five_words(text):
    words = (text or "").encode().lower().split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = near_texts(15)
    sentences = [f"the quick brown fox number {i} jumps over the lazy dog and runs away from {i * 7} hunters in the deep forest" for i in range(30)]
    item = "what is the airspeed velocity of an unladen swallow. about eleven metres per second or so they say."
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts + sentences)]
    rows += [(900, f"some words before {item} and after", "en", "s0", 10), (901, "here token=abcdefghijklmnop12 ends the line", "en", "s1", 43), (902, "12 34", "en", "s0", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        kept[name] = {r.doc_id: r for r in out.collect()}
        if name != "mixing":
            assert out.columns == docs.columns
            path = f"{tmp_path}/{name}"
            out.write.parquet(path)
            now = spark.read.parquet(path)
    assert 902 not in kept["language_id"] and 900 in kept["language_id"]
    sets = {i: frozenset(five_words(r.text)) for i, r in kept["language_id"].items()}
    wanted = components([(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))], sets)
    assert set(kept["near_dedup"]) == {i for i in sets if wanted[i] == i}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {900}
    assert set(kept["secret_scan"]) == set(kept["decontamination"]) and "[secret]" in kept["secret_scan"][901].text
    assert {i: r.size for i, r in kept["mixing"].items()} == {i: len((r.text or "").split()) for i, r in kept["secret_scan"].items()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mixing"])
