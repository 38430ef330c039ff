"""Benchmark decontamination: size-partitioned MinHash containment search.

Items (short test texts) and documents are sets of ``words``-word shingles. Items are partitioned by
size into classes 32, 64, 128 ...: class m holds items of more than m/2 and up to m shingles (the first:
of more than ``DIRECT``). A long document would drown a short item in one signature, so for class m its shingle
sequence is read in windows of 2m that advance by m. A signature has ``BINS`` bins by the top bits of the
shingle hash, each with the least hash in it (MinHash by one permutation). An item and a document are a
candidate when some bin of the item's signature equals that bin of one of the document's windows in the
item's class. Items of up to ``DIRECT`` shingles have too few bins for that: they are indexed by every shingle,
and all that share enough shingles with the whole document are candidates, so none of them is missed.
Candidates are checked by exact containment in the whole document: ``den * shared >= num * item size``.

The items' signatures and sets go to the tasks; they are cut into blocks of ``block_bytes`` at most, and
each block is one pass over the documents, whose hits are stored before the next block is sent, so what is
sent is bounded and no rows of documents are shuffled. Each document is judged in one task with memory in
proportion to its own length, and texts come in small batches.

Null or empty texts have no shingles and match nothing; texts of fewer words are one shingle; repeated
rows give equal result rows once; a null id stays null. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import no_null, null_again, shingle_batch, small_batches, stored, text_batches

BINS, BASE, DIRECT = 64, 32, 16
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def size_class(n: int) -> int:
    c = 0
    while n > BASE << c:
        c += 1
    return c


def signature(tokens: np.ndarray) -> np.ndarray:
    table = np.full(BINS, EMPTY)
    np.minimum.at(table, (tokens >> np.uint64(58)).astype(np.int64), tokens)
    return table


def item_sets(items: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, raws in text_batches(batch["text"]):
                flat, offsets = shingle_batch(raws, words)
                out += [np.unique(flat[offsets[i]:offsets[i + 1]]).tobytes() for i in range(len(raws))]
            yield pd.DataFrame({"item_id": batch["item_id"], "tokens": out})

    return items.select(no_null("item_id"), "text").mapInPandas(run, "item_id long, tokens binary")


class ItemIndex:
    """The items of one block: short ones by all their shingles, others by size class with the values of
    their signatures."""

    def __init__(self, items: list[tuple[int | None, bytes]], num: int, den: int):
        self.num, self.den = num, den
        self.ids = [i for i, _ in items]
        self.sets = [np.frombuffer(t, np.uint64) for _, t in items]
        found: dict[int, list[tuple[int, int]]] = {}
        short = []
        for k, tokens in enumerate(self.sets):
            if 0 < len(tokens) <= DIRECT:
                short.extend((int(v), k) for v in tokens)
            elif len(tokens):
                sig = signature(tokens)
                found.setdefault(size_class(len(tokens)), []).extend((int(v), k) for v in sig[sig != EMPTY])
        self.classes = {c: self._sorted(rows) for c, rows in found.items()}
        self.short = self._sorted(short)
        self.sizes = np.array([len(t) for t in self.sets], np.int64)

    @staticmethod
    def _sorted(rows: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values in order, whose they are, and which leading bits occur."""
        rows.sort()
        values = np.array([r[0] for r in rows], np.uint64)
        seen = np.zeros(1 << 20, bool)
        seen[(values >> np.uint64(44)).astype(np.int64)] = True
        return values, np.array([r[1] for r in rows], np.int64), seen

    def short_ones(self, flat: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs of short items with enough shared shingles, one document at a time."""
        values, items, seen = self.short
        found = set()
        if not len(values):
            return found
        at = np.flatnonzero(seen[(flat >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(values, flat[at], "left"), np.searchsorted(values, flat[at], "right")
        at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
        doc = np.searchsorted(offsets, at, "right") - 1
        cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
        for p, q in zip(cut[:-1], cut[1:], strict=True):
            if q == p:
                continue
            first, one = np.unique(lo[p:q], return_index=True)  # each shingle once
            size = hi[p:q][one] - first
            place = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            own, shared = np.unique(items[place], return_counts=True)
            found.update((int(doc[p]), int(k)) for k in own[self.den * shared >= self.num * self.sizes[own]])
        return found

    def candidates(self, flat: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs for the documents of one batch."""
        counts = np.diff(offsets)
        blocks = -(-counts // BASE)
        starts = np.concatenate([[0], np.cumsum(blocks)])
        doc = np.repeat(np.arange(len(counts)), counts)
        block = starts[doc] + (np.arange(len(flat)) - offsets[doc]) // BASE
        table = np.full(int(starts[-1]) * BINS, EMPTY)
        np.minimum.at(table, block * BINS + (flat >> np.uint64(58)).astype(np.int64), flat)
        table = table.reshape(-1, BINS)
        owner = np.repeat(np.arange(len(counts)), blocks)
        place = np.arange(len(owner)) - starts[owner]
        found = self.short_ones(flat, offsets)
        for c in range(max(self.classes, default=-1) + 1):
            if c:
                first = np.flatnonzero(place % 2 == 0)
                table, owner, place = np.minimum.reduceat(table, first, axis=0), owner[first], place[first] // 2
            if c not in self.classes:
                continue
            window = table.copy()
            same = np.flatnonzero(owner[:-1] == owner[1:])
            window[same] = np.minimum(table[same], table[same + 1])
            values, items, seen = self.classes[c]
            row, col = np.nonzero(seen[(window >> np.uint64(44)).astype(np.int64)])
            got = window[row, col]
            lo, hi = np.searchsorted(values, got, "left"), np.searchsorted(values, got, "right")
            for r, a, b in zip(owner[row[hi > lo]], lo[hi > lo], hi[hi > lo], strict=True):
                found.update((int(r), int(k)) for k in items[a:b])
        return found


def find_leaks(docs: DataFrame, items: DataFrame, words: int = 5, num: int = 80, den: int = 100,
               block_bytes: int = 32_000_000) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` for every document and item it contains."""
    spark = docs.sparkSession
    with small_batches(spark):
        sets = stored(item_sets(items, words))
    size = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    docs = docs.select(no_null("doc_id"), "text")
    out = None
    for b in range(blocks):
        part = sets.where(F.pmod(F.xxhash64("item_id", "tokens"), F.lit(blocks)) == b).distinct()
        rows = sorted(((r["item_id"], bytes(r["tokens"])) for r in part.collect()), key=lambda r: r[1])
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index = ItemIndex(sent.value, num, den)
            for batch in batches:
                found, ids = [], batch["doc_id"].tolist()
                for first, raws in text_batches(batch["text"]):
                    flat, offsets = shingle_batch(raws, words)
                    for d, k in sorted(index.candidates(flat, offsets)):
                        own = index.sets[k]
                        inter = int(np.isin(own, flat[offsets[d]:offsets[d + 1]]).sum())
                        if den * inter >= num * len(own):
                            found.append((ids[first + d], index.ids[k], len(own), inter, inter / len(own)))
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        with small_batches(spark):
            hits = stored(docs.mapInPandas(run, "doc_id long, item_id long, n_item long, n_shared long, containment double"))
        sent.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out.distinct().withColumns({c: null_again(c) for c in ("doc_id", "item_id")})
