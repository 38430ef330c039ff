"""Repeated passages by merging Burrows-Wheeler transforms.

Every byte covered by a ``length``-byte string that also starts earlier (smaller doc_id, or earlier in
the same document) is removed.

1. Splitting the work. Each ``length``-byte string is filed under the least hash of its ``GRAM``-byte
   parts, which depends on its bytes alone, so equal strings meet under one hash. Neighbouring strings
   of one document under one hash form a context (their bytes together). Only hashes are shuffled here:
   (file, hash of the context's bytes, doc_id, place, number of strings).
2. Equal contexts: all but the earliest are repeats as a whole. The earliest one needs a closer look only
   if its file holds other contexts too, or if it may repeat in itself (its least part comes twice in it).
   Only those contexts' bytes are fetched.
3. Closer look, file by file in bounded chunks of whole files: contexts are dealt to shards; each shard's
   suffixes are sorted and its transform taken (over symbols of up to 20 bytes, ``step`` of them, a divisor of ``length``;
   one sequence from each of ``step`` places); the
   shards' transforms are merged by iterative interleave refinement: round h puts the interleave in order
   of the first h symbols, by one stable pass over the merged transform, and marks where neighbours
   begin to differ. After ``length / step`` rounds the unmarked runs are the intervals of suffixes with a
   common prefix of ``length`` bytes; merging never compares or sorts suffixes again. In every interval
   all but the earliest string are repeats.
4. Repeats become byte runs per document, joined with the texts: by broadcast if there are few documents
   with repeats, else by a shuffled join.

A chunk holds whole files. A file whose distinct contexts have more than ``chunk_bytes`` bytes (different
surroundings of one short passage) is hot and never in one task: its contexts are cut into their strings, and each
string is filed under a hash of all its bytes, so that only equal strings meet, by a partial
aggregate that finds the earliest. So a task of step 3 holds less than two ``chunk_bytes`` of contexts.

Null text is empty; texts shorter than ``length`` lose nothing; rows that repeat a doc_id are that document
again (they should have its text; runs beyond a shorter text are ignored); a null doc_id comes first in
order. Extra columns are ignored; empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelscope.llm.common import NO_ID, no_null, null_again, scramble, signed, small_batches, stored

GRAM = 32
STEP = 4


def gram_hashes(raw: bytes) -> np.ndarray:
    """Hashes of all ``GRAM``-byte parts, doubled up from 8-byte words."""
    h = scramble(np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,)))
    width = 8
    while width < GRAM:
        h = scramble(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + (h[width:] ^ (h[width:] >> np.uint64(29))))
        width *= 2
    return h


def sliding(best: np.ufunc, h: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while s * 2 <= w:
        h = best(h[:-s], h[s:])
        s *= 2
    return best(h[:len(h) - (w - s)], h[w - s:]) if s < w else h


def contexts_of(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(file, first string, number of strings, may repeat in itself) of each context of a text."""
    w = length - GRAM + 1
    h = gram_hashes(raw)
    least = sliding(np.minimum, h, w)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    # parts that are the least of some string; equal ones at most w apart (in one context) mean text with a short period
    edge = np.zeros(w - 1, np.uint64)
    part = np.flatnonzero(h == sliding(np.maximum, np.concatenate([edge, least, edge]), w))
    twice = np.flatnonzero((np.diff(part) <= w) & (h[part[1:]] == h[part[:-1]]))
    again = np.zeros(len(first) + 1, np.int64)
    if len(twice):
        np.add.at(again, np.searchsorted(first, np.maximum(part[twice] - w + 1, 0), "right") - 1, 1)
        np.add.at(again, np.searchsorted(first, part[twice + 1], "right"), -1)
    return least[first], first, np.diff(np.concatenate([first, [len(least)]])), np.cumsum(again[:-1]) > 0


def _files(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            parts, n = [], 0
            for doc, text in zip(batch["doc"].tolist(), batch["text"], strict=True):
                raw = text.encode() if isinstance(text, str) else b""
                if len(raw) < length:
                    continue
                file, first, count, again = contexts_of(raw, length)
                ends = first + count + (length - 1)
                name = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)),
                                   np.uint64, len(first))
                parts.append((file, name, np.full(len(first), doc), first, count, again))
                n += len(first)
                if n > 200_000:
                    yield frame(parts)
                    parts, n = [], 0
            if parts:
                yield frame(parts)

    def frame(parts: list) -> pd.DataFrame:
        file, name, doc, first, count, again = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"file": signed(file), "name": signed(name), "doc": doc, "first": first, "n": count, "again": again})

    return docs.mapInPandas(run, "file long, name long, doc long, first long, n long, again boolean")


def packed_sort(names: list[np.ndarray], bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(stable order by the names, those of 64 bits together sorted as one number with their index; whether each one
    begins other names than the one before). ``bits`` tells how many each column of names needs."""
    n = len(names[0])
    low = max(n - 1, 1).bit_length()
    if sum(bits) + low > 64 or low > 31:
        order = np.lexsort(names[::-1])
        fresh = np.ones(n, bool)
        fresh[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in names])
        return order, fresh
    key = names[0].astype(np.uint64)
    for x, more in zip(names[1:], bits[1:], strict=True):
        key <<= np.uint64(more)
        np.bitwise_or(key, x, out=key, dtype=np.uint64, casting="unsafe")
    key <<= np.uint64(low)
    np.bitwise_or(key, np.arange(n, dtype=np.uint32), out=key, dtype=np.uint64, casting="unsafe")
    key.sort()
    order = key.astype(np.uint32)
    order &= np.uint32((1 << low) - 1)
    key >>= np.uint64(low)
    fresh = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    return order.view(np.int32), fresh


def stable_order(x: np.ndarray, many: int) -> np.ndarray:
    """The stable order of whole numbers below ``many``."""
    return packed_sort([x], [max(many - 1, 1).bit_length()])[0]


def symbol_bytes(length: int) -> int:
    """Bytes of a symbol: wide ones need fewer rounds. They must divide ``length``."""
    return max(x for x in range(STEP, 21) if length % x == 0)


def symbols_of(contexts: list[bytes], step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol at every byte, first byte of every context, number of symbols): a symbol stands for ``step``
    bytes, four at least, and keeps their order. Names of four bytes are doubled up."""
    raw = np.frombuffer(b"".join(contexts) + b"\0" * 3, np.uint8).astype(np.uint32)
    names, bits, width = [raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]], 32, 4
    del raw
    while True:
        order, fresh = packed_sort(names, [bits] * len(names))
        name = np.empty(len(order), np.int32)
        name[order] = np.cumsum(fresh, dtype=np.int32) - 1
        many = int(fresh.sum())
        if width == step:
            break
        more = min(width, step - width)
        then = np.concatenate([name[more:], np.zeros(min(more, len(name)), np.int32)])
        names, bits, width = [name, then], max(many - 1, 1).bit_length(), width + more
    size = np.array([len(c) for c in contexts])
    return name, np.concatenate([[0], np.cumsum(size)[:-1]]), many


class Shard:
    """The transform of some contexts: sequences of ``step``-byte symbols from each of ``step`` places."""

    def __init__(self, symbols: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray, kind: type, step: int = STEP):
        phase = np.tile(np.arange(step), len(start))
        m = np.maximum((np.repeat(size, step) - phase) // step, 0)
        total = int((m + 1).sum())
        ends = np.cumsum(m + 1)
        seq = np.repeat(np.arange(len(m), dtype=np.int32), m + 1)
        at = np.arange(total)
        left = (ends - 1)[seq] - at  # symbols up to the end
        place = m[seq] - left
        byte = phase[seq] + step * place
        symbol = symbols[np.minimum(np.repeat(start, step)[seq] + byte, len(symbols) - 1)]
        rank = np.where(left > 0, symbol + 1, 0)
        order = self._suffixes(rank, left, int(symbols.max(initial=0)) + 2)
        self.starts = place[order] == 0  # no symbol before: the end mark
        before = np.where(self.starts, 0, order - 1)
        self.bwt = symbol[before].astype(kind)
        stands = np.empty(total, np.int32)
        stands[order] = np.arange(total, dtype=np.int32)
        self.back = np.where(self.starts, -1, stands[before])  # where the suffix one symbol longer stands
        self.context = np.asarray(number, np.int32)[seq[order] // step]
        self.byte = byte[order].astype(np.int32)

    @staticmethod
    def _suffixes(rank: np.ndarray, left: np.ndarray, many: int) -> np.ndarray:
        """The order of all suffixes, equal ones by place. Only suffixes that still have equals are sorted on."""
        total = len(rank)
        if not total:
            return np.empty(0, np.int64)

        def heads(fresh: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(place of the first of each one's equals, whether it has equals)"""
            alone = fresh & np.concatenate([fresh[1:], [True]])
            return np.maximum.accumulate(np.where(fresh, at, 0)), ~alone

        order, fresh = packed_sort([rank], [max(many - 1, 1).bit_length()])
        head, shared = heads(fresh, np.arange(total, dtype=np.int32))
        name = np.empty(total, np.int32)
        name[order] = head
        at, width, longest, bits = np.flatnonzero(shared), 1, int(left.max()), total.bit_length()
        while width <= longest and len(at):
            some = order[at]
            # beyond the end is 0, less than any name
            then = np.where(left[some] >= width, name[np.minimum(some + width, total - 1)] + 1, 0)
            by, fresh = packed_sort([name[some], then], [bits, bits])
            some = some[by]
            head, shared = heads(fresh, at)
            order[at], name[some] = some, head
            at = at[shared]
            width *= 2
        return order


def merged_intervals(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, context, byte place) of every suffix whose first ``rounds`` symbols some other one has too; suffixes of
    one interval have them equal.

    The interleave is held as the suffixes' numbers. A suffix alone in its interval stays so, and so does, a round later,
    the one that is a symbol longer: both leave the interleave, and a round passes over what is left."""
    base = np.concatenate([[0], np.cumsum([len(s.bwt) for s in shards])])
    back = np.concatenate([np.where(s.back < 0, -1, s.back + at).astype(np.int32) for s, at in zip(shards, base.tolist(), strict=False)])
    bwt = np.concatenate([s.bwt for s in shards])
    many = int(bwt.max(initial=0)) + 1
    here, block = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    open_ = np.ones(len(bwt), bool)
    size, blocks = len(bwt), 1
    for _ in range(rounds):
        longer = back[here]
        kept = np.flatnonzero((longer >= 0) & open_[longer]).astype(np.int32)
        order = stable_order(bwt[here[kept]], many)
        kept = kept[order]
        now, b = longer[kept], block[kept]
        s = bwt[here[kept]]
        fresh = np.ones(len(now) + 1, bool)
        fresh[1:-1] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        shared = ~(fresh[:-1] & fresh[1:])
        open_[here] = False
        here, block = now[shared], np.cumsum(fresh[:-1], dtype=np.int32)[shared]
        open_[here] = True
        found = int((fresh[:-1] & shared).sum())
        if not found or (size, blocks) == (len(here), found):
            break  # nothing was told apart: no later round will
        size, blocks = len(here), found
    return block, np.concatenate([s.context for s in shards])[here], np.concatenate([s.byte for s in shards])[here]


def repeated_strings(contexts: list[bytes], doc: np.ndarray, first: np.ndarray, n: np.ndarray, length: int,
                     shard_bytes: int = 262_144) -> tuple[np.ndarray, np.ndarray]:
    """(context, place) of every string that also starts earlier in these contexts."""
    step = symbol_bytes(length)
    symbols, start, many = symbols_of(contexts, step)
    size = np.array([len(c) for c in contexts])
    cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // shard_bytes)) + 1, [len(contexts)]])
    kind = np.uint16 if many < 65536 else np.uint32
    shards = [Shard(symbols, start[p:q], size[p:q], np.arange(p, q), kind, step) for p, q in zip(cut, cut[1:], strict=False) if q > p]
    block, context, byte = merged_intervals(shards, length // step)
    whole = byte < n[context]
    block, context, byte = block[whole], context[whole].astype(np.int64), byte[whole].astype(np.int64)
    order = np.lexsort((first[context] + byte, doc[context], block))
    later = np.zeros(len(order), bool)
    later[1:] = block[order][1:] == block[order][:-1]
    # two rows of one document and place are one string
    same = (doc[context][order][1:] == doc[context][order][:-1]) & (
        (first[context] + byte)[order][1:] == (first[context] + byte)[order][:-1])
    later[1:] &= ~same
    got = order[later]
    return context[got], byte[got]


def _closer(asked: DataFrame, length: int, chunk_bytes: int) -> DataFrame:
    """``doc, a, b``: byte runs of repeats among ``file, doc, first, n, raw``."""
    def chunk(rows: list[tuple]) -> pd.DataFrame:
        doc, first, n = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        context, place = repeated_strings([r[4] for r in rows], doc, first, n, length)
        order = np.lexsort((place, context))
        context, place = context[order], place[order]
        if not len(context):
            return pd.DataFrame({"doc": [], "a": [], "b": []}, dtype=np.int64)
        cut = np.concatenate([[0], np.flatnonzero((context[1:] != context[:-1]) | (place[1:] != place[:-1] + 1)) + 1])
        last = np.concatenate([cut[1:], [len(context)]]) - 1
        c = context[cut]
        return pd.DataFrame({"doc": doc[c], "a": first[c] + place[cut], "b": first[c] + place[last] + length})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(batch[c].tolist() for c in ("file", "doc", "first", "n", "raw")), strict=True):
                if size >= chunk_bytes and r[0] != rows[-1][0]:
                    yield chunk(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
        if rows:
            yield chunk(rows)

    return asked.repartition("file").sortWithinPartitions("file", "doc", "first").mapInPandas(run, "doc long, a long, b long")


def hot_files(asks: DataFrame, length: int, most: int) -> DataFrame:
    """``file`` of the files whose contexts (``file, n``) have more than ``most`` bytes."""
    return asks.groupBy("file").agg(F.sum(F.col("n") + length - 1).alias("bytes")).where(F.col("bytes") > most).select("file")


def string_hashes(raw: bytes, length: int) -> np.ndarray:
    """A hash of all bytes of every ``length``-byte string, from those of its parts."""
    h, n = gram_hashes(raw), len(raw) - length + 1
    out = np.zeros(n, np.uint64)
    for at in (*range(0, length - GRAM, GRAM), length - GRAM):
        out = scramble(out * np.uint64(0x9E3779B97F4A7C15) + (h[at:at + n] ^ (h[at:at + n] >> np.uint64(29))))
    return out


def _hot_repeats(asked: DataFrame, length: int) -> DataFrame:
    """``doc, a, b``: byte runs of repeats among ``file, doc, first, n, raw``, string by string."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in range(0, len(batch), 1024):
                part = batch.iloc[x:x + 1024]
                names = [string_hashes(raw, length) for raw in part["raw"]]
                n = np.array([len(name) for name in names])
                file, doc, at = (np.repeat(part[c].to_numpy(), n) for c in ("file", "doc", "first"))
                place = at + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"file": file, "name": signed(np.concatenate(names)), "doc": doc, "at": at, "place": place})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, places in zip(batch["doc"].tolist(), batch["places"], strict=True):
                places = np.asarray(places)
                edge = np.flatnonzero(np.diff(places) > 1)
                out += [(doc, int(a), int(b) + length) for a, b in zip(places[[0, *(edge + 1)]], places[[*edge, -1]], strict=True)]
            yield pd.DataFrame(out, columns=["doc", "a", "b"])

    with small_batches(asked.sparkSession):
        strings = stored(asked.mapInPandas(cut, "file long, name long, doc long, at long, place long"))
    lead = strings.groupBy("file", "name").agg(F.min(F.struct("doc", "place")).alias("lead"), F.count("*").alias("many"))
    later = strings.join(lead.where("many > 1"), ["file", "name"]).where(F.col("lead") != F.struct("doc", "place"))
    places = later.groupBy("doc", "at").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return places.mapInPandas(joined, "doc long, a long, b long")


def _with_texts(docs: DataFrame, per_doc: DataFrame, how: str, most_broadcast: int) -> DataFrame:
    small = F.broadcast(per_doc) if per_doc.count() <= most_broadcast else per_doc
    return docs.join(small, "doc", how)


def remove_repeats(docs: DataFrame, length: int = 100, chunk_bytes: int = 2_000_000, most_broadcast: int = 500_000) -> DataFrame:
    """``doc_id, runs`` (merged removed byte runs: pairs of 64-bit numbers), ``text`` for every row."""
    if length % STEP or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of {STEP} and at least {2 * GRAM}")
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    here = Window.partitionBy("file").orderBy("name", "doc", "first")
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # a string at the earliest one's own place is that string (a repeated row)
    lead = F.first(F.struct("doc", "first")).over(Window.partitionBy("file", "name").orderBy("doc", "first"))
    filed = _files(docs.select("doc", "text"), length).select(
        "*", (lead != F.struct("doc", "first")).alias("copy"),
        (F.first("name").over(whole) != F.last("name").over(whole)).alias("mixed"))
    filed = filed.where(F.col("copy") | F.col("mixed") | F.col("again"))
    with small_batches(docs.sparkSession):
        filed = stored(filed.select("file", "doc", "first", "n", "copy"))

    each = filed.where("not copy").select("file", "doc", "first", "n").distinct()
    hot = stored(hot_files(each, length, chunk_bytes))
    n_hot = hot.count()
    sent = F.broadcast(hot) if n_hot <= most_broadcast else hot

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for doc, text, own in zip(batch["doc"].tolist(), batch["text"], batch["asks"], strict=True):
                raw = text.encode()
                for x in own:
                    a, n = x["first"], x["n"]
                    part = raw[a:a + n + length - 1]
                    if len(part) == n + length - 1:
                        out.append((x["file"], doc, a, n, part))
                        size += len(part)
                if size > 4_000_000:
                    yield pd.DataFrame(out, columns=["file", "doc", "first", "n", "raw"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["file", "doc", "first", "n", "raw"])

    texts = docs.where("text is not null").select("doc", "text")

    def bytes_of(asked: DataFrame) -> DataFrame:
        asks = stored(asked.groupBy("doc").agg(F.collect_list(F.struct("file", "first", "n")).alias("asks")))
        return _with_texts(texts, asks, "inner", most_broadcast).mapInPandas(
            fetch, "file long, doc long, first long, n long, raw binary")

    closer = _closer(bytes_of(each.join(sent, "file", "left_anti") if n_hot else each), length, chunk_bytes)
    if n_hot:
        closer = closer.unionByName(_hot_repeats(bytes_of(each.join(sent, "file", "left_semi")), length))
    copies = filed.where("copy").select("doc", F.col("first").alias("a"), (F.col("first") + F.col("n") + length - 1).alias("b"))
    runs = copies.unionByName(closer).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own in batch["runs"]:
                done: list[list[int]] = []
                for x in own:
                    if done and x["a"] <= done[-1][1]:
                        done[-1][1] = max(done[-1][1], x["b"])
                    else:
                        done.append([x["a"], x["b"]])
                out.append(np.array(done, "<i8").tobytes())
            yield pd.DataFrame({"doc": batch["doc"], "runs": out})

    with small_batches(docs.sparkSession):
        runs = stored(runs.mapInPandas(merge, "doc long, runs binary"))
    return _with_texts(docs, runs, "left", most_broadcast).select("doc_id", "runs", "text")


def kept_bytes(text: str | None, runs: bytes | None) -> tuple[int, list[tuple[int, int]], bytes]:
    """(bytes of the text, its removed runs, the bytes that stay)."""
    raw = text.encode() if isinstance(text, str) else b""
    cut = [(int(a), min(int(b), len(raw))) for a, b in np.frombuffer(runs or b"", "<i8").reshape(-1, 2) if a < len(raw)]
    parts, at = [], 0
    for a, b in cut:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return len(raw), cut, b"".join(parts)


def digests(removed: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``; stored."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, runs in zip(batch["text"], batch["runs"], strict=True):
                size, cut, kept = kept_bytes(text, runs)
                out.append((size, size - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    with small_batches(removed.sparkSession):
        out = stored(removed.select(no_null("doc_id"), "runs", "text").mapInPandas(
            run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return out.withColumn("doc_id", null_again("doc_id"))
