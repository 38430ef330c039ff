"""N-gram Jaccard join: a size-aware heavy-light set join.

A document's set is its distinct ``words``-word shingles (64-bit hashes). Two sets are linked when
``den * intersection >= num * union``. Equal sets are one node, named by a 64-bit hash of the set.

All sets are ordered by one global order of shingles: shingles of a fixed quarter of the hash space that
occur in fewer than T sets, then the other three quarters, then the quarter's frequent ones. T grows with
the square root of the number of documents, so the list of frequent shingles is bounded by a quarter of
the mean set size times that root; should it still exceed ``most_frequent``, T doubles. The order only
decides the work, never the result. Linked sets of size s share a shingle in their first
``s - ceil(num * s / den) + 1`` ones (the prefix), and two shingles in one more.

* Small sets: every 2-subset of the prefix is a key.
* Large sets: every shingle of the prefix is a key, and its inverted list is scanned.
* The boundary is the largest size at which enumerating subsets costs no more keys than the single
  shingles cost in keys and expected list rows (from the counted list lengths). Small sets that may meet
  a set beyond the boundary write both.

Candidates. Within a key, sets are ordered by a MinHash value, so like sets are neighbours; neighbours
are candidates first (linear in the list), twice more in the order of other MinHash values among sets
that are not connected yet, in a few lists of each set. Only then are the lists that still hold several
components compared in full, across components, block by block in the tasks by the bound below; only
pairs that pass it are written. So no link between different texts is lost, while a group of near
copies costs few rows.

Check. A parity bitmap of about two bits a shingle, made in the first pass, bounds the difference of two sets from below and
drops most false candidates; only for the rest are whole shingle sets made, from one document each, and intersected. Both
run in the JVM.

Null text is empty; empty sets link with nothing; rows with null doc_id have null component; repeated
rows are rows of one node. Extra columns are ignored; empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.llm.common import (components, discard, no_null, null_again, scramble, shingle_batch, signed, small_batches,
                                  stored, text_batches)

QUARTER = np.uint64(1 << 62)
MINHASH = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    num: int = 80
    den: int = 100

    def own_overlap(self, s: int) -> int:
        return -(-self.num * s // self.den)

    def prefix(self, s: int) -> int:
        return s - self.own_overlap(s) + 1


def document_sets(batches: Iterator[pd.DataFrame], like: Likeness) -> Iterator[tuple]:
    """(batch, row number, sorted distinct shingles) of each text; (batch, -1, None) ends a batch. What Arrow holds unused goes
    back with each batch, so idle workers stay small."""
    import pyarrow as pa

    for batch in batches:
        for first, raws in text_batches(batch["text"]):
            flat, offsets = shingle_batch(raws, like.words)
            for i in range(len(raws)):
                yield batch, first + i, np.unique(flat[offsets[i]:offsets[i + 1]])
        yield batch, -1, None
        del batch
        pa.default_memory_pool().release_unused()


def set_name(tokens: np.ndarray) -> int:
    import xxhash

    value = xxhash.xxh3_64_intdigest(tokens.tobytes())
    return value - (1 << 64) if value >> 63 else value


def _sets_and_counts(docs: DataFrame, like: Likeness) -> DataFrame:
    """Two kinds of rows from one pass: ``doc_id, size, node, bits`` of every document (token null), and counts
    ``n`` of the ``token``s of the first quarter of the hash space, summed over some hundred thousand at a time."""
    names = ["doc_id", "size", "node", "token", "n", "bits"]

    def counted(parts: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        frame = pd.DataFrame({"token": signed(values), "n": counts}).reindex(columns=names[:-1]).astype("Int64")
        return frame.assign(bits=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        meta, parts, size = [], [], 0
        for batch, i, tokens in document_sets(batches, like):
            if i >= 0:
                meta.append((len(tokens), set_name(tokens), parity_bits(tokens)) if len(tokens) else (0, None, None))
                parts.append(tokens[:np.searchsorted(tokens, QUARTER)].copy())
                size += len(parts[-1])
            elif len(batch):
                frame = pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "size": [m[0] for m in meta],
                                      "node": pd.array([m[1] for m in meta], dtype="Int64")})
                frame = frame.astype("Int64").reindex(columns=names[:-1]).astype("Int64")
                yield frame.assign(bits=pd.Series([m[2] for m in meta], dtype=object))
                meta = []
            if size > 250_000:
                yield counted(parts)
                parts, size = [], 0
        if size:
            yield counted(parts)

    out = docs.select(no_null("doc_id"), "text").mapInPandas(
        run, "doc_id long, size long, node long, token long, n long, bits array<long>")
    return out.withColumn("doc_id", null_again("doc_id"))


def boundary(like: Likeness, mean_list: float, most: int = 10_000) -> int:
    """The largest set size for which 2-subsets of the prefix cost no more than its inverted lists."""
    best = 0
    for s in range(2, most):
        p = like.prefix(s)
        if like.own_overlap(s) >= 2 and (p + 1) * p / 2 <= p * (1 + mean_list):
            best = s
    return best


def _keys(docs: DataFrame, like: Likeness, frequent: np.ndarray, small: int) -> DataFrame:
    """``key, x (node, size, pos), m0, m1, m2``: the keys of every set, and three MinHash values of it."""
    lowest = next(s for s in range(1, 10_000) if like.own_overlap(s) >= 2)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def told(keys: list[np.ndarray], places: list[np.ndarray], sets: list[tuple]) -> pd.DataFrame:
        rows = np.array(sets, np.int64)
        rows = np.repeat(rows[:, 1:], rows[:, 0], axis=0)
        return pd.DataFrame({"key": signed(np.concatenate(keys)), "node": rows[:, 0], "size": rows[:, 1].astype(np.int32),
                             "pos": np.concatenate(places).astype(np.int32), "m0": rows[:, 2].astype(np.int32),
                             "m1": rows[:, 3].astype(np.int32), "m2": rows[:, 4].astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = shared.value
        keys, places, sets, n = [], [], [], 0
        for _, i, tokens in document_sets(batches, like):
            s = len(tokens) if i >= 0 else 0
            if s:
                cut = int(np.searchsorted(tokens, QUARTER))
                own = tokens[:cut]
                if len(often) and cut:
                    at = np.searchsorted(often, own)
                    hit = often[np.minimum(at, len(often) - 1)] == own
                    order = np.concatenate([own[~hit], tokens[cut:], own[hit]])
                else:
                    order = tokens
                p, made = like.prefix(s), []
                if s <= small and s >= lowest:
                    pairs = np.array(list(combinations(range(min(p + 1, s)), 2)), np.int64).reshape(-1, 2)
                    made.append((scramble(order[pairs[:, 0]] * np.uint64(3) ^ scramble(order[pairs[:, 1]])), pairs[:, 1] - 1))
                if s > small or s * like.den >= like.num * (small + 1) or s * like.num <= like.den * (lowest - 1):
                    made.append((order[:p], np.arange(p)))
                low = [int((tokens * m).min() >> np.uint64(34)) for m in MINHASH]
                mine = sum(len(k) for k, _ in made)
                sets.append((mine, set_name(tokens), s, *low))
                keys += [k for k, _ in made]
                places += [pos for _, pos in made]
                n += mine
            if n > 100_000:
                yield told(keys, places, sets)
                keys, places, sets, n = [], [], [], 0
        if n:
            yield told(keys, places, sets)

    return docs.select("text").mapInPandas(run, "key long, node long, size int, pos int, m0 int, m1 int, m2 int")


def _neighbours(keys: DataFrame) -> DataFrame:
    """The rows of ``_keys`` whose list has others: ``key, x, m1, m2``, ``p`` (the set before, in the order of ``m0``) and
    ``long`` (the list has three rows or more). A task streams through its sorted lists with two rows of each side at hand."""
    names = ["key", "node", "size", "pos", "m1", "m2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(rows: pd.DataFrame, first: int, last: int) -> pd.DataFrame:
            key = rows["key"].to_numpy()
            at = np.arange(first, last)

            def like_key(step: int) -> np.ndarray:
                to = at + step
                inside = (to >= 0) & (to < len(key))
                return inside & (key[np.clip(to, 0, len(key) - 1)] == key[at])

            p1, p2, n1, n2 = (like_key(k) for k in (-1, -2, 1, 2))
            keep = p1 | n1
            out = rows.iloc[at[keep]].reset_index(drop=True)
            before = rows.iloc[np.maximum(at[keep] - 1, 0)].reset_index(drop=True)
            return out.assign(after=p1[keep], p_node=before["node"], p_size=before["size"], p_pos=before["pos"],
                              long=(p2 | n2 | (p1 & n1))[keep])

        past, rows = 0, None
        for batch in batches:
            rows = pd.concat([rows, batch[names]], ignore_index=True) if rows is not None else batch[names]
            last = max(past, len(rows) - 2)
            if last > past:
                yield told(rows, past, last)
            first = max(0, last - 2)
            rows, past = rows.iloc[first:], last - first
        if rows is not None and len(rows) > past:
            yield told(rows, past, len(rows))

    schema = "key long, node long, size int, pos int, m1 int, m2 int, after boolean, p_node long, p_size int, p_pos int, long boolean"
    dealt = keys.repartition("key").sortWithinPartitions("key", "m0", "node", "pos")
    p = F.struct(F.col("p_node").alias("node"), F.col("p_size").alias("size"), F.col("p_pos").alias("pos"))
    return dealt.mapInPandas(run, schema).select("key", F.struct("node", "size", "pos").alias("x"), "m1", "m2",
                                                 F.when(F.col("after"), p).alias("p"), "long")


def _may_link(like: Likeness, a: str, b: str) -> Column:
    """Size and position bounds for sets ``a`` and ``b`` (structs) that share a key."""
    sa, sb = F.col(f"{a}.size").cast("long"), F.col(f"{b}.size").cast("long")
    left = F.least(sa - F.col(f"{a}.pos"), sb - F.col(f"{b}.pos"))
    sizes = F.least(sa, sb) * like.den >= F.greatest(sa, sb) * like.num
    return sizes & (left * (like.num + like.den) >= (sa + sb) * like.num)


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of a power of two of bits, about two a shingle, as 64-bit words; a bit is the parity of its shingles."""
    width = max(256, 1 << (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(3)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def difference_bound(a: bytes, b: bytes) -> int:
    """A lower bound of the size of the symmetric difference; the longer bitmap is folded."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    for long, short in ((a, b), (b, a)):
        width = len(long) * 8
        while width > len(short) * 8:
            width //= 2
            if long is a:
                x = (x >> width) ^ (x & ((1 << width) - 1))
            else:
                y = (y >> width) ^ (y & ((1 << width) - 1))
    return (x ^ y).bit_count()


def _difference(x: Column, y: Column) -> Column:
    """``difference_bound`` of two bitmap columns; 0 where one is more than twice as long as the other."""
    n = F.least(F.size(x), F.size(y))

    def folded(c: Column) -> Column:
        halves = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(c) > n, halves).otherwise(c)

    counted = F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    found = F.aggregate(counted, F.lit(0), lambda total, k: total + F.coalesce(k, F.lit(0)))
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * n, found).otherwise(0)


def _whole_sets(nodes: DataFrame, docs: DataFrame, meta: DataFrame, like: Likeness, most_broadcast: int) -> DataFrame:
    """``node, tokens`` of the given nodes, from one document each; from those without id where there is no other."""
    reps = stored(meta.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    few = reps.count() <= most_broadcast

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = [], 0
        for _, i, tokens in document_sets(batches, like):
            if i >= 0 and len(tokens):
                out.append((set_name(tokens), signed(tokens)))
                n += len(tokens)
            if n > 300_000 or i < 0 and out:
                yield pd.DataFrame(out, columns=["node", "tokens"])
                out, n = [], 0

    ids = reps.where("doc_id is not null").select("doc_id").distinct()
    chosen = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
    found = chosen.mapInPandas(run, "node long, tokens array<long>")
    if reps.where("doc_id is null").head(1):
        nameless = docs.where("doc_id is null").select("text").mapInPandas(run, "node long, tokens array<long>")
        found = found.unionByName(nameless.join(reps.where("doc_id is null").select("node"), "node", "left_semi"))
    with small_batches(docs.sparkSession):  # rows that repeat a doc_id or have none may give a node twice
        return stored(found.dropDuplicates(["node"]))


def _check(pairs: DataFrame, bits: DataFrame, whole, like: Likeness) -> DataFrame:
    """The linked ones of ``pairs`` (a, b: nodes). ``whole`` gives the sets of nodes."""
    both = pairs.join(bits.toDF("a", "xs", "xb"), "a").join(bits.toDF("b", "ys", "yb"), "b")
    possible = _difference(F.col("xb"), F.col("yb")) * (like.num + like.den) <= (F.col("xs") + F.col("ys")) * (like.den - like.num)
    rest = stored(both.where(possible).select("a", "b"))
    sets = whole(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    both = rest.join(sets.toDF("a", "ta"), "a").join(sets.toDF("b", "tb"), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    linked = shared * like.den >= (F.size("ta") + F.size("tb") - shared) * like.num
    return both.where(linked).select("a", "b")


def _labelled(member: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the lists that still hold several components, with their component."""
    named = member.join(roots.toDF("r_node", "root"), F.col("x.node") == F.col("r_node"), "left").drop("r_node")
    named = named.withColumn("root", F.coalesce("root", "x.node"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return named.join(mixed, "key", "left_semi")


def _folded(bits: list[bytes], words: int) -> np.ndarray:
    """Bitmaps of ``words`` or twice as many 64-bit words, folded to ``words``."""
    x = np.stack([np.frombuffer(b, "<u8") for b in bits])
    return x if x.shape[1] == words else x[:, :words] ^ x[:, words:]


def block_pairs(one: pd.DataFrame, other: pd.DataFrame, like: Likeness, most_words: int = 2_000_000) -> Iterator[tuple]:
    """Node arrays (a, b) of the pairs of two blocks of a list that may be linked: components differ, and
    sizes and bitmaps allow it. Sets that may be linked have bitmaps of equal or of double length."""
    by_width = [{w: g for w, g in x.groupby(x["bits"].map(len) // 8)} for x in (one, other)]
    for w, g in by_width[0].items():
        for v in (w // 2, w, 2 * w):
            h = by_width[1].get(v)
            if h is None:
                continue
            words = min(v, w)
            x, y = _folded(g["bits"], words), _folded(h["bits"], words)
            gs, gr, gn = (g[c].to_numpy() for c in ("size", "root", "node"))
            hs, hr, hn = (h[c].to_numpy() for c in ("size", "root", "node"))
            step = max(1, most_words // (len(h) * words))
            for at in range(0, len(g), step):
                s = gs[at:at + step, None]
                ok = (np.minimum(s, hs) * like.den >= np.maximum(s, hs) * like.num) & (gr[at:at + step, None] != hr)
                if not ok.any():
                    continue
                far = np.bitwise_count(x[at:at + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)
                i, k = np.nonzero(ok & (far * (like.num + like.den) <= (s + hs) * (like.den - like.num)))
                if len(i):
                    yield gn[at:at + step][i], hn[k]


def _across(mixed: DataFrame, bits: DataFrame, like: Likeness, block: int) -> DataFrame:
    """The possible pairs (a, b) across components of every list. Lists of the same least set (by hash), such as those of one
    passage's shingles, hold mostly the same sets and are compared as one, so a pair is not found once per list. A list is cut
    into blocks; two blocks meet in one task, and only pairs that pass the bitmap bound are written."""
    least = mixed.groupBy("key").agg(F.min(F.xxhash64("node")).alias("home"))
    mixed = stored(mixed.join(least, "key").select(F.col("home").alias("key"), "node", "size", "root").distinct())
    lengths = mixed.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = mixed.join(lengths, "key").join(bits.select("node", "bits"), "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "node",
                       F.col("size").cast("long").alias("size"), "root", "bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, found = ["key", "lo", "hi"], []

        def meet(group: pd.DataFrame) -> Iterator[tuple]:
            lo = group["own"].to_numpy() == group["lo"].iloc[0]
            one, other = (group, group) if group["lo"].iloc[0] == group["hi"].iloc[0] else (group[lo], group[~lo])
            yield from block_pairs(one, other, like)

        def short(rows: pd.DataFrame) -> None:
            """All pairs of many short lists of one block each, by distance in the list."""
            key, s, root, node, bits = (rows[c].to_numpy() for c in ("key", "size", "root", "node", "bits"))
            d = 1
            while True:
                same = np.flatnonzero(key[d:] == key[:-d])
                if not len(same):
                    return
                x, y = same, same + d
                ok = (root[x] != root[y]) & (np.minimum(s[x], s[y]) * like.den >= np.maximum(s[x], s[y]) * like.num)
                for i, k in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    if difference_bound(bits[i], bits[k]) * (like.num + like.den) <= (s[i] + s[k]) * (like.den - like.num):
                        found.append((min(node[i], node[k]), max(node[i], node[k])))
                d += 1

        def told() -> pd.DataFrame:
            out = pd.DataFrame(sorted(set(found)), columns=["a", "b"], dtype="int64")
            found.clear()
            return out

        held: list[pd.DataFrame] = []
        for batch in batches:
            batch["bits"] = [x.tobytes() for x in batch["bits"]]
            rows = pd.concat([*held, batch]) if held else batch
            values = rows[name].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(rows)]])
            length = np.diff(cuts)
            held = [rows.iloc[cuts[-2]:]]
            few = (length <= 64) & (values[cuts[:-1], 1] == values[cuts[:-1], 2])
            few[-1] = False
            short(rows[np.repeat(few, length)])
            for i in np.flatnonzero(~few[:-1]):
                for a, b in meet(rows.iloc[cuts[i]:cuts[i + 1]]):
                    found.extend(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
            yield told()
        if held:
            for a, b in meet(held[0]):
                found.extend(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
            yield told()

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links: components of the roots only."""
    if not links.head(1):
        return roots
    a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    met = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    upper = components(met).toDF("root", "top")
    moved = roots.join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    own = upper.join(roots.select(F.col("node").alias("root")), "root", "left_anti").toDF("node", "root")
    return stored(moved.unionByName(own))


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(f"{a}.node", f"{b}.node").alias("a"), F.greatest(f"{a}.node", f"{b}.node").alias("b")).distinct()


def jaccard_components(docs: DataFrame, like: Likeness, most_frequent: int = 4_000_000, most_broadcast: int = 2_000_000,
                       tries: int = 24, block: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row. ``tries`` bounds the early candidates of a set
    (see above); whatever they leave open is joined in full afterwards."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    with small_batches(docs.sparkSession):
        first = stored(_sets_and_counts(docs, like))
    meta = stored(first.where("size is not null").select("doc_id", "size", "node"))
    bits = stored(first.where("node is not null").select("node", "size", "bits").dropDuplicates(["node"]))
    total = meta.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
    counts = stored(first.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1"))
    discard(first)
    by_length = counts.groupBy("n").agg(F.count("*").alias("lists")).collect()  # one row per list length
    often = max(32, math.isqrt(total["n"]) + 1)
    while sum(r["lists"] for r in by_length if r["n"] >= often) > most_frequent:
        often *= 2
    frequent = np.sort(counts.where(F.col("n") >= often).select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    rare = [(r["n"], r["lists"]) for r in by_length if r["n"] < often]
    single = max((total["s"] or 0) / 4 - sum(r["n"] * r["lists"] for r in by_length), 1)
    mean_list = (single + sum(n * n * k for n, k in rare)) / (single + sum(n * k for n, k in rare))
    small = boundary(like, mean_list)

    with small_batches(docs.sparkSession):
        lists = stored(_neighbours(_keys(docs, like, frequent, small)))
    near = lists.where("p is not null and p.node <> x.node").where(_may_link(like, "p", "x"))
    seen = stored(_pairs(near, "p", "x"))
    # every list of two different sets is checked by now; longer ones go on
    member = stored(lists.where("long").select("key", "x", "m1", "m2").distinct())
    discard(lists)

    def check(pairs: DataFrame) -> DataFrame:
        return stored(_check(pairs, bits, lambda nodes: _whole_sets(nodes, docs, meta, like, most_broadcast), like))

    roots = components(check(seen))
    for order in ("m1", "m2"):
        mixed = stored(_labelled(member, roots))
        # ties (near copies) in another order in each list, and a few lists for each set
        here = Window.partitionBy("key").orderBy(order, F.xxhash64("x.node", "key", F.lit(order)))
        near = mixed.select("key", "x", "root", F.lag("x").over(here).alias("p"), F.lag("root").over(here).alias("p_root"))
        some = Window.partitionBy("x.node").orderBy(F.xxhash64("key", F.lit(order)))
        near = near.where("p_root <> root").where(_may_link(like, "p", "x"))
        near = near.withColumn("k", F.row_number().over(some)).where(F.col("k") <= tries)
        new = stored(_pairs(near, "p", "x").join(seen, ["a", "b"], "left_anti"))
        seen = seen.unionByName(new)
        roots = _merged(roots, check(new))
        discard(mixed)
    mixed = stored(_labelled(member, roots).select("key", "x.node", "x.size", "root"))
    new = stored(_across(mixed, bits, like, block).join(seen, ["a", "b"], "left_anti"))
    roots = _merged(roots, check(new))

    named = meta.join(roots, "node", "left").withColumn("g", F.coalesce("root", "node"))
    named = named.select("doc_id", "size", "g")
    least = named.where("g is not null").groupBy("g").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "g", "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
