"""Embedding near-duplicates by a pivot-permutation index.

Pivots are a bounded sample of the distinct vectors (square root of their number, ``most_pivots`` at most, chosen by hash).
Every vector is described by its nearest pivots in order of nearness: ``near`` of them, or half the square root of the number
of pivots if that is more, so that the share of a cluster's pivots a vector is filed under does not shrink as pivots are added.
Inverted lists hold, for each pivot, the vectors that have it among their nearest, with its place in their order.

Two vectors of a list are candidates if their orders share ``shared`` pivots or more; candidates are verified by cosine in
double precision. A pair is judged once, in the list of the first pivot in the order of its lesser node that both have: so a
lesser node is looked at only in the lists of its first pivots, those after which ``shared - 1`` more may follow. Pairs that
share fewer pivots are not found. The index is the same at every number of vectors; the tests and the README give the share found.

Equal vectors are one node with a count, so copies cost nothing. A list is cut into blocks of about ``block`` members by
ranges of the node's hash, which meet block by block, so a task holds two blocks at most, however many vectors share a pivot.
No pairs are written: a block gives each vector its number of links and the smallest node of its component inside the
block; these star edges are joined by ``components``.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do
rows with null vec_id (their component is null). Vectors of different length do not link. Rows that
repeat id and vector are one vector. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import components, stored

def _unit(vectors) -> np.ndarray:
    x = np.stack([np.frombuffer(v, "<f8") for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def valid_vector(v):
    big = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & (big > 0), F.lit(False))


def _as_binary(rows: DataFrame) -> DataFrame:
    """``node, dim, vec`` (little-endian doubles) from ``node, v`` (array of double)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            arrays = [np.asarray(v, "<f8") for v in b["v"]]
            yield pd.DataFrame({"node": b["node"], "dim": [len(a) for a in arrays], "vec": [a.tobytes() for a in arrays]})

    return rows.mapInPandas(run, "node long, dim int, vec binary")


def lists_of(near: int, pivots: int) -> int:
    """Under how many of ``pivots`` pivots a vector is filed."""
    return min(pivots, max(near, math.isqrt(pivots) // 2))


def near_pivots(vectors: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The nearest pivots of unit vectors, nearest first."""
    m = lists_of(near, len(pivots))
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :m].astype("<i4")


def _describe(vectors: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """One row per vector and near pivot: ``pivot, place, node, n, vec, tops``."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at:at + 1024]
                tops = near_pivots(_unit(part["vec"]), p, near)
                raw = [t.tobytes() for t in tops]
                again = np.repeat(np.arange(len(part)), tops.shape[1])
                yield pd.DataFrame({"pivot": tops.ravel(), "place": np.tile(np.arange(tops.shape[1], dtype=np.int32), len(part)),
                                    "node": part["node"].to_numpy()[again], "n": part["n"].to_numpy()[again],
                                    "vec": part["vec"].to_numpy()[again], "tops": [raw[i] for i in again]})

    return vectors.mapInPandas(run, "pivot int, place int, node long, n long, vec binary, tops binary")


def shared_after(a: np.ndarray, places: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For orders ``a`` (rows) and ``b`` that share the pivot at ``places`` of ``a``: how many pivots of ``a`` after it
    ``b`` has too; negative where ``b`` has one before it."""
    names = np.intersect1d(a, b)

    def at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.minimum(np.searchsorted(names, x), len(names) - 1)
        return column, names[column] == x

    left, right = np.zeros((len(a), len(names)), np.float32), np.zeros((len(b), len(names)), np.float32)
    column, known = at(a)
    step = np.sign(np.arange(a.shape[1]) - places[:, None])
    weight = np.where(step < 0, -float(a.shape[1]), step)
    left[np.nonzero(known)[0], column[known]] = weight[known]
    column, known = at(b)
    right[np.nonzero(known)[0], column[known]] = 1
    return left @ right.T


def block_links(h: pd.DataFrame, m: pd.DataFrame, num: float, shared: int, same: bool) -> pd.DataFrame:
    """``node, links, root`` of rows ``h`` against rows ``m`` of a list (``same``: they are the same rows). No node
    of ``h`` is greater than one of ``m`` unless they are the same rows, then they ascend by node."""
    none = pd.DataFrame({"node": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
    if not len(h) or not len(m):
        return none
    a, b = (np.stack([np.frombuffer(t, "<i4") for t in r["tops"]]) for r in (h, m))
    least = min(shared, a.shape[1])
    x = np.flatnonzero(h["place"].to_numpy() <= a.shape[1] - least)  # else too few pivots follow
    if not len(x):
        return none
    ok = shared_after(a[x], h["place"].to_numpy()[x], b) >= least - 1
    if same:
        ok &= np.arange(len(m)) > x[:, None]
    u, v = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))  # the rows that have candidates
    if not len(u):
        return none
    ok[np.ix_(u, v)] &= (_unit(h["vec"].iloc[x[u]]) @ _unit(m["vec"].iloc[v]).T) >= num
    i, j = np.nonzero(ok)
    if not len(i):
        return none
    i = x[i]
    hn, mn = h["node"].to_numpy(), m["node"].to_numpy()
    names, at = np.unique(np.concatenate([hn, mn]), return_inverse=True)
    a, b = at[:len(hn)][i], at[len(hn):][j]
    links = np.zeros(len(names), np.int64)
    np.add.at(links, a, m["n"].to_numpy()[j])
    np.add.at(links, b, h["n"].to_numpy()[i])
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    touched = np.zeros(len(names), bool)
    touched[a] = touched[b] = True
    return pd.DataFrame({"node": names[touched], "links": links[touched], "root": names[root[touched]]})


def _met(rows: DataFrame, num: float, shared: int, block: int) -> DataFrame:
    """``node, links, root`` rows of all pairs of ``pivot, place, node, n, vec, tops, blocks`` in one pivot's blocks."""
    share = F.floor((F.col("node") / F.lit(2.0 ** 64) + 0.5) * F.col("blocks"))  # ascends with node
    rows = rows.withColumn("own", F.greatest(F.lit(0), F.least(share, F.col("blocks") - 1)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"hb": F.least("own", "other"), "mb": F.greatest("own", "other")})

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, hb, mb = key
        rows = rows.sort_values("node")
        h, m, out = rows[rows["own"] == hb], rows[rows["own"] == mb], []
        for x in range(0, len(h), block):
            for y in range(x if hb == mb else 0, len(m), block):
                out.append(block_links(h.iloc[x:x + block], m.iloc[y:y + block], num, shared, hb == mb and x == y))
        return pd.concat(out) if out else block_links(h, m.iloc[:0], num, shared, False)

    return rows.select("pivot", "hb", "mb", "own", "place", "node", "n", "vec", "tops").groupBy("pivot", "hb", "mb").applyInPandas(
        run, "node long, links long, root long")


def embedding_links(vectors: DataFrame, num: float, near: int, shared: int, most_pivots: int, block: int) -> DataFrame:
    """``node, links, root`` rows (several per node) for ``node, n, vec`` of one length."""
    k = min(most_pivots, max(32, math.isqrt(vectors.count()) + 1))
    sample = vectors.orderBy(F.xxhash64("node", F.lit("pivot")), "node").limit(k).select("vec").collect()  # k rows
    lists = stored(_describe(vectors, _unit([r["vec"] for r in sample]), near))
    sizes = lists.groupBy("pivot").count().collect()  # one row per pivot
    blocks = F.create_map(*[F.lit(x) for r in sizes for x in (r["pivot"], -(-r["count"] // block))])
    return _met(lists.withColumn("blocks", blocks[F.col("pivot")].cast("int")), num, shared, block)


def near_duplicates(table: DataFrame, num: float = 0.95, near: int = 12, shared: int = 2, most_pivots: int = 4096,
                    block: int = 2048) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vec_id, embedding``."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("node", F.when(valid_vector(F.col("v")) & F.col("vec_id").isNotNull(), F.xxhash64("v")))
    nodes = rows.where("node is not null").select("vec_id", "node").distinct().groupBy("node").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = stored(nodes)
    vectors = stored(_as_binary(rows.where("node is not null").select("node", "v")).dropDuplicates(["node"]).join(nodes, "node"))
    found = None
    for r in vectors.select("dim").distinct().collect():  # the lengths that occur
        own = embedding_links(vectors.where(F.col("dim") == r["dim"]).select("node", "n", "vec"), num, near, shared,
                              most_pivots, block)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = table.sparkSession.createDataFrame([], "node long, links long, root long")
    found = stored(found)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = info.groupBy("root").agg(F.min("least").alias("component_id"))
    info = info.join(low, "root").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "node").join(info, "node", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
