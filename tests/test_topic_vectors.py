"""M1 and M2: sparse weights and density topics against plain computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from reelscope.operators import density
from reelscope.operators import topics as M
from reelscope.operators.graph import connected


def plain_topics(vectors, least, points):
    """Every pair, then growing regions."""
    x = {i: np.array(v, float) / np.linalg.norm(v) for i, v in vectors
         if i is not None and v and all(e is not None and math.isfinite(e) for e in v) and any(v)}
    near = {i: [j for j in x if len(x[i]) == len(x[j]) and x[i] @ x[j] >= least] for i in x}
    cores = sorted(i for i in x if len(near[i]) >= points)
    root = {}
    for i in cores:
        todo = [] if i in root else [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += [k for k in near[j] if k in cores]
    out = {}
    for i, _ in vectors:
        best = min(((-round(float(x[i] @ x[j]), 9), j) for j in near.get(i, []) if j in root), default=None)
        out[i] = (root[i], True) if i in root else (root[best[1]], False) if best else (-1, False)
    return out


def odd_vectors():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 12))
    some = [(int(i), (centres[i % 6] + rnd.normal(size=12) * rnd.choice([0.1, 0.35, 0.9])).tolist()) for i in range(300)]
    some += [(2000 + i, some[5][1]) for i in range(60)]  # copies
    return some + [(3000, None), (3001, [0.0] * 12), (3002, [float("nan")] * 12), (3003, [None] * 12), (3004, []), (3005, [1.0, 2.0]),
                   (3006, [1.0, 2.0]), (3007, [2.0, 4.2]), (None, some[0][1])]


@pytest.mark.parametrize("pivots,block", [(1, 70), (24, 2000)])
def test_density_topics_against_all_pairs(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(density, "BLOCK", block)
    vectors = odd_vectors()
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = density.density_topics(df, min_similarity=0.9, min_points=3, pivots=pivots).collect()
    assert len(got) == len(vectors)
    assert {r.vec_id: (r.topic, r.is_core) for r in got} == plain_topics(vectors, 0.9, 3)


@pytest.mark.parametrize("least", [0.3, 0.9])
def test_density_topics_compare_only_what_is_open(spark, monkeypatch, least):
    monkeypatch.setattr(density, "BLOCK", 60)
    vectors = odd_vectors()
    asked, placed = [], density._placed
    monkeypatch.setattr(density, "_placed", lambda points, *a: (asked.append(points.where("asks").count()), placed(points, *a))[1])
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = density.density_topics(df, min_similarity=least, min_points=3).collect()
    assert {r.vec_id: (r.topic, r.is_core) for r in got} == plain_topics(vectors, least, 3)
    assert len(asked) == 2 and all(n < 300 for n in asked)  # of 303 different vectors


def test_density_topics_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert density.density_topics(df).count() == 0


def test_connected(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1200)]
    edges += [(2000, k) for k in range(2001, 2300)] + [(9, 9)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = connected(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)


def test_tfidf_weights(spark):
    texts = ["the cat sat on the mat", "The dog", None, "", "x", "the Été là été", "the cat sat on the mat"]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    bags = [Counter(w for w in (t or "").lower().split() if len(w) > 1) for t in texts]
    held = Counter(w for b in bags for w in b)
    want = {}
    for i, b in enumerate(bags):
        w = {t: n * math.log((1 + len(texts)) / (1 + held[t])) for t, n in b.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): x / norm for t, x in w.items()}
    got = {(r.doc_id, r.term): r.weight for r in M.tfidf_weights(df, "doc_id", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_tfidf_weights_of_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(M, "PACKED_ROWS", 3)
    monkeypatch.setattr(M, "COUNTED_BYTES", 40)  # a key goes on over many parts
    rnd = random.Random(6)
    rows = [(rnd.choice([None, 1, 2, 3, 4]), " ".join(rnd.choices(["aa", "bb", "cc", "été", "dd", "ee", "zz"], k=rnd.randrange(9)))) for _ in range(60)]
    rows += [(7, None), (8, ""), (9, "aa rare")]
    bags = {}
    for k, t in rows:
        bags.setdefault(k, Counter()).update(t.split() if t else [])
    held = Counter(w for b in bags.values() for w in b)
    want = {}
    for k, b in bags.items():
        w = {t: n * math.log((1 + len(rows)) / (1 + held[t])) for t, n in b.items()}
        want |= {(k, t): x / math.sqrt(sum(y * y for y in w.values())) for t, x in w.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.term, r.weight) for r in M.tfidf_weights(df, "doc_id", "text").collect()]
    assert len(got) == len(want) and all(abs(w - want[k, t]) < 1e-12 for k, t, w in got)


def test_tfidf_shuffles_texts_not_their_terms(spark):
    texts = [" ".join(f"w{(i * 7 + j * j) % 900}" for j in range(300)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = M.tfidf_weights(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert M.tfidf_weights(df.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_nearest_centre_ties_and_lengths(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], 4), (2, [0.0, 2.0], 7), (3, [1.0, 1.0], -1), (4, [1.0], -1), (5, None, -1), (6, [0.0, 0.0], -1)],
                              "vec_id long, embedding array<double>, topic long")
    got = {r.vec_id: r.topic for r in M.assign_to_centres(e, M.topic_centres(e), "vec_id").collect()}
    assert got == {1: 4, 2: 7, 3: 4, 4: None, 5: None, 6: 4}
