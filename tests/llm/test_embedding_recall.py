"""Embedding links inside clusters, found through the pivot lists at every size."""

import numpy as np
import pandas as pd
import pytest

from reelscope.llm import embedding_dedup


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def clustered(rng, centres, n, inner):
    """Unit vectors (and their centres) whose cosine inside a cluster is about ``inner``."""
    c = centres[rng.integers(0, len(centres), n)]
    g = rng.normal(size=c.shape)
    g = unit(g - (g * c).sum(1, keepdims=True) * c)
    return np.sqrt(inner) * c + np.sqrt(1 - inner) * g, c


def planted(rng, x, c, inner, cosine):
    """A partner in the same cluster for every x, at exactly ``cosine``."""
    r = unit(x - (x * c).sum(1, keepdims=True) * c)
    g = rng.normal(size=x.shape)
    g -= (g * c).sum(1, keepdims=True) * c
    g = unit(g - (g * r).sum(1, keepdims=True) * r)
    rho = ((cosine - inner) / (1 - inner))[:, None]
    return np.sqrt(inner) * c + np.sqrt(1 - inner) * (rho * r + np.sqrt(1 - rho * rho) * g)


@pytest.mark.parametrize("pivots", [32, 256, 1000, 4096])
@pytest.mark.parametrize("inner", [0.0, 0.8, 0.9])
def test_planted_pairs_share_two_pivots(pivots, inner):
    rng = np.random.default_rng(7)
    centres = unit(rng.normal(size=(10, 64)))
    p, _ = clustered(rng, centres, pivots, inner)
    x, c = clustered(rng, centres, 1000, inner)
    y = planted(rng, x, c, inner, rng.uniform(0.95, 0.97, 1000))
    a, b = (embedding_dedup.near_pivots(v, p, 12) for v in (x, y))
    assert np.mean([len(np.intersect1d(s, t)) >= 2 for s, t in zip(a, b, strict=True)]) >= 0.995


def test_the_order_is_kept():
    rng = np.random.default_rng(9)
    x, p = unit(rng.normal(size=(50, 16))), unit(rng.normal(size=(40, 16)))
    order = embedding_dedup.near_pivots(x, p, 12)
    near = np.take_along_axis(x @ p.T, order.astype(int), 1)
    assert (np.diff(near, axis=1) <= 0).all() and (near[:, -1] >= np.sort(x @ p.T, axis=1)[:, -12]).all()


def test_shared_pivots_are_counted_after_the_first_one():
    rng = np.random.default_rng(10)
    a, b = (np.stack([rng.permutation(30)[:8] for _ in range(40)]) for _ in range(2))
    a[:, 3], places = 99, np.full(40, 3)
    b[:, 5] = 99
    got = embedding_dedup.shared_after(a, places, b)
    for i, x in enumerate(a.tolist()):
        for j, y in enumerate(b.tolist()):
            if set(x[:3]) & set(y):
                assert got[i, j] < 0
            else:
                assert got[i, j] == len(set(x[4:]) & set(y))


@pytest.mark.parametrize("inner", [0.8, 0.9])
def test_recall_of_whole_runs(spark, inner):
    rng = np.random.default_rng(8)
    centres = unit(rng.normal(size=(10, 64)))
    x, c = clustered(rng, centres, 18_000, inner)
    y = planted(rng, x[:3000], c[:3000], inner, rng.uniform(0.95, 0.97, 3000))
    v = np.concatenate([x, y])
    table = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v)}))
    want = np.concatenate([(v[i:i + 3000] @ v.T >= 0.95).sum(axis=1) - 1 for i in range(0, len(v), 3000)])
    assert want.sum() >= 6000
    got = embedding_dedup.near_duplicates(table, block=500).toPandas().set_index("vec_id")["n_links"].sort_index().to_numpy()
    assert (got <= want).all()
    print("recall", inner, got.sum() / want.sum())
    assert got.sum() >= 0.99 * want.sum()
