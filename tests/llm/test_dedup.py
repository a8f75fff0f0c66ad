import random

import brute
import numpy as np
import pytest

from shardloom.llm.common import components
from shardloom.llm.embedding_dedup import near_duplicates as near_vectors
from shardloom.llm.embedding_dedup import op5_embedding_near_dedup, spherical_kmeans
from shardloom.llm.minhash_dedup import deduplicated, match_threshold, near_duplicates, op8_minhash_near_dedup

DOCS = "doc_id long, text string, seq string, class int, component_id string"  # extra columns clash on purpose


def texts(seed=1):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([3, 8, 40, 120]))]
        for _ in range(rnd.choice([1, 2, 6])):
            copy = [word() if rnd.random() < rnd.choice([0, 0.01, 0.03]) else w for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    hot = [word() for _ in range(60)]
    for _ in range(150):  # a large group of near copies
        copy = list(hot)
        for _ in range(rnd.choice([1, 1, 2, 3])):
            copy[rnd.randrange(60)] = word()
        rows.append((n, " ".join(copy)))
        n += 1
    passage = " ".join(word() for _ in range(20))  # shared, but too short to link
    rows += [(n + i, passage + " " + " ".join(word() for _ in range(60))) for i in range(40)]
    n += 40
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, rows[3][1].upper()), (n + 7, rows[3][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize(("w", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, w, percent):
    rows = texts()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows), shingle=w, percent=percent).collect()}
    expected = {i: (n, c, i == c) for i, (n, c) in brute.near_classes(rows, w, percent).items()}
    assert got == expected


def test_op8_on_the_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_minhash_near_dedup(spark, sf_dir).collect()}
    assert got == brute.near_classes(rows, 3, 85)


def test_near_duplicates_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (None, None, True)], key=str)
    empty = near_duplicates(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    kept = deduplicated(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "None", "None"]


def test_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c = "a b c d e f g h", "k l m n o p q r", "s t u v w x y z"
    rows = [(3, a), (3, a), (5, a), (None, a), (5, c), (None, b), (None, b), (None, b.upper()), (7, "one more text that stands quite alone"), (3, "another text under a repeated number here")]
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), None)
    got = sorted(((r["doc_id"], r["text"].lower()) for r in out.collect()), key=str)
    assert out.columns == frame(spark, rows).columns
    assert got == sorted([(3, a), (5, c), (None, b), rows[8], rows[9]], key=str)
    rows = texts()
    kept = {i for i, (_, c) in brute.near_classes(rows, 5, 80).items() if i == c}
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), None).collect()) == sorted(kept)


def test_match_threshold():
    assert match_threshold(0.85, 64) == 40 and match_threshold(0.01, 64) == 1


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 300 + i) for i in range(50)] + [(rnd.randrange(400, 500), rnd.randrange(400, 500)) for _ in range(80)] + [(1, 1), (2, None)]
    rnd.shuffle(edges)
    c = brute.Sets()
    for a, b in edges:
        if b is not None and a != b:
            c.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {x: c.root(x) for x in c.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=2):
    rng = np.random.RandomState(seed)
    base = rng.randn(30, 16)
    rows = []
    for i in range(400):
        v = base[rng.randint(30)] + rng.randn(16) * rng.choice([0.02, 0.08, 0.2])
        rows.append((i, [float(x) for x in v], int(rng.randint(3))))
    rows += [(400 + i, rows[i][1], rows[i][2]) for i in range(20)]  # exact copies
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] + [1.0] * 15, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 1), (506, [2.0, 4.0], 1), (507, [], 1), (508, [float("inf")] * 16, 1)]
    return rows


def test_near_vectors_equal_brute_force(spark):
    rows = vectors()
    sound = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and None not in v and np.isfinite(v).all() and any(v)]
    c, links = brute.Sets(), dict.fromkeys((r[0] for r in rows), 0)
    for a, (i, v, l) in enumerate(sound):
        for j, w, m in sound[:a]:
            if l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                c.join(i, j)
                links[i] += 1
                links[j] += 1
    df = spark.createDataFrame([(i, v, l, 1, True) for i, v, l in rows], "vec_id long, embedding array<double>, label int, cell int, home boolean")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert got == {i: (n, c.root(i), c.root(i) == i) for i, n in links.items()}
    assert near_vectors(df.limit(0)).count() == 0


def test_op5_on_the_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = op5_embedding_near_dedup(spark, sf_dir)
    assert got.count() == n and got.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_kmeans_is_spherical():
    x = np.random.RandomState(0).randn(200, 8)
    c = spherical_kmeans(x / np.linalg.norm(x, axis=1, keepdims=True), 5)
    assert np.allclose(np.linalg.norm(c, axis=1), 1)
