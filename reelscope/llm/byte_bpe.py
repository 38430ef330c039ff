"""Byte-level BPE by a monoid tree: encoding and decoding of text columns.

A text is cut into the matches of ``pattern``; each match is encoded by itself, and a match that is one token is
that token, as the usual library has it. The encodings of byte strings form a monoid: ``joined(a, b)`` is the encoding of
both strings together. A match is encoded by halves (cut at a power of two) down to leaves of ``LEAF`` bytes, joining on the
way up. All new matches of a batch go up their trees together: leaves, and the windows of one level, are merged at once, a merge
of every string in each numpy step.

Joining re-encodes a window around the boundary, at first one token of each side. It is settled once the window's
encoding begins and ends with the very tokens the window began and ended with; else the side that changed takes twice as
many tokens. That is a proof: a token sequence is the encoding of its bytes if and only if each two neighbours are the encoding
of their own bytes, for a merge across a boundary would be the first one in the encoding of the two tokens beside it as well.
Neighbours outside the window were neighbours in ``a`` or ``b``, those inside are in the window's own encoding.

Encodings of whole matches are kept in a task's cache of at most ``CACHE_BYTES``, which ends with the task. Ids are little-endian unsigned 32-bit integers in one binary value, so a longer text's ids are the concatenation of its
parts' ids; decoding concatenates the tokens' bytes. Long texts are worked through in pieces of ``PIECE`` characters or
more that end before white space, where no match of the pattern goes across.

Null and empty texts have no ids and decode to the empty string. All functions act on columns: other columns of any name,
repeated rows and empty tables pass through as they are.
"""

from __future__ import annotations

import base64
import heapq
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CACHE_BYTES = 48_000_000
ENTRY_BYTES = 150  # about what a cached match and its ids take besides their bytes
LEAF = 16
SMALL = 48
FEW = 12  # strings merged one by one, as numpy steps would cost more
NEVER = 1 << 32
NO_TOKEN = -1
PIECE = 200_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to id from a rank file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


def pair_ranks(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every two tokens that make a token: ``left << 32 | right`` ascending, and the id of what they make."""
    found = sorted((left << 32 | right, i) for token, i in ranks.items() for cut in range(1, len(token))
                   if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None)
    both = np.array(found, np.int64).reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class Tree:
    """Encoder over the ranks of one vocabulary, with its cache."""

    def __init__(self, ranks: dict[bytes, int], pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs = pair_ranks(ranks) if pairs is None else pairs
        self.single = np.array([ranks.get(bytes([i]), NO_TOKEN) for i in range(256)], np.int64)
        self.words: dict[str, bytes] = {}
        self.kept = 0

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """The encoding by its definition: the neighbours of the lowest rank merge first, the leftmost of equals."""
        if len(raw) > SMALL:
            return self._merged_long(raw)
        rank = self.ranks.get
        parts = [raw[i:i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i:i + 2], NEVER) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) < NEVER:
            i = pairs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        return tuple([self.ranks[p] for p in parts])

    def _merged_long(self, raw: bytes) -> tuple[int, ...]:
        n, rank = len(raw), self.ranks.get
        end, back = list(range(1, n + 1)), list(range(-1, n))  # a part's end by its start, its start by its end
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != e:
                continue
            end[middle], end[i], back[e] = 0, e, i
            for a, b in ((i, end[e] if e < n else 0), (back[i] if i else n, e)):
                if a < b <= a + self.longest and (r := rank(raw[a:b])) is not None:
                    heapq.heappush(heap, (r, a, b))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i:end[i]]])
            i = end[i]
        return tuple(out)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what two tokens make, ``NEVER`` if nothing."""
        keys, made = self.pairs
        if not len(keys):
            return np.full(left.shape, NEVER)
        key = (left << 32) + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (left >= 0) & (right >= 0), made[at], NEVER)

    def _merged_rows(self, raws: list[bytes]) -> list[tuple[int, ...]]:
        """``merged`` of many short strings, one merge of each in a step."""
        width = max(map(len, raws))
        raw = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raws]), np.uint8).reshape(-1, width)
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        ids = np.where(np.arange(width) < length[:, None], self.single[raw], NO_TOKEN)
        rows, live = np.arange(len(raws)), ids.copy()
        rank = self._rank(live[:, :-1], live[:, 1:])
        columns = np.arange(width)
        while rank.shape[1]:
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), best]
            going = least < NEVER
            if not going.all():
                ids[rows[~going]] = live[~going]
                rows, live, rank, best, least = rows[going], live[going], rank[going], best[going], least[going]
            if not len(rows):
                break
            n = np.arange(len(rows))
            follow = np.minimum(columns + (columns > best[:, None]), width - 1)
            live = np.take_along_axis(live, follow, axis=1)
            live[n, best], live[:, -1] = least, NO_TOKEN  # a token's id is its rank
            rank = np.take_along_axis(rank, follow[:, :-1].clip(max=width - 2), axis=1)
            rank[:, -1] = NEVER
            rank[n, np.minimum(best, width - 2)] = self._rank(live[n, best], live[n, np.minimum(best + 1, width - 1)])
            some = best > 0
            rank[n[some], best[some] - 1] = self._rank(live[n[some], best[some] - 1], live[n[some], best[some]])
            length[rows] -= 1
        else:
            ids[rows] = live
        flat, ends = ids[columns < length[:, None]].tolist(), np.cumsum(length).tolist()
        return [tuple(flat[i:j]) for i, j in zip([0, *ends], ends, strict=False)]

    def merged_many(self, raws: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """``merged`` of each distinct string."""
        out, rows = {}, sorted(set(raws), key=len)
        short = [r for r in rows if len(r) <= SMALL] if len(rows) > FEW else []
        for r in rows[len(short):]:
            out[r] = self.merged(r)
        at = 0
        for most in (LEAF // 2, LEAF, SMALL):
            to = at
            while to < len(short) and len(short[to]) <= most:
                to += 1
            if to > at:
                out.update(zip(short[at:to], self._merged_rows(short[at:to]), strict=True))
            at = to
        return out

    def joined_many(self, pairs: list[tuple]) -> list[tuple[int, ...]]:
        """The encoding of the bytes of each two encodings together."""
        out: list = [()] * len(pairs)
        token = self.tokens.__getitem__
        open_ends = [(k, 1, 1) for k in range(len(pairs))]
        while open_ends:
            asked = []
            for k, left, right in open_ends:
                a, b = pairs[k]
                first, last = max(len(a) - left, 0), min(right, len(b))
                asked.append((k, left, right, first, last, b"".join(map(token, a[first:] + b[:last]))))
            found = self.merged_many(x[-1] for x in asked)
            open_ends = []
            for k, left, right, first, last, raw in asked:
                a, b = pairs[k]
                window = found[raw]
                ahead = first > 0 and window[0] != a[first]
                behind = last < len(b) and window[-1] != b[last - 1]
                if ahead or behind:
                    open_ends.append((k, left << ahead, right << behind))
                else:
                    out[k] = a[:first] + window + b[last:]
        return out

    def encoded_many(self, raws: list[bytes]) -> list[tuple[int, ...]]:
        """The encoding of each string: its leaves, then level by level the neighbours joined. A string's leaf
        without a neighbour waits for the level that has one, which is the cut at a power of two."""
        leaves = [[r[i:i + LEAF] for i in range(0, len(r), LEAF)] for r in raws]
        found = self.merged_many(x for own in leaves for x in own)
        parts = [[found[x] for x in own] for own in leaves]
        todo = [k for k, own in enumerate(parts) if len(own) > 1]
        while todo:
            joined = iter(self.joined_many([(parts[k][i], parts[k][i + 1]) for k in todo for i in range(0, len(parts[k]) - 1, 2)]))
            for k in todo:
                own = parts[k]
                parts[k] = [next(joined) for _ in range(len(own) // 2)] + own[len(own) & ~1:]
            todo = [k for k in todo if len(parts[k]) > 1]
        return [own[0] if own else () for own in parts]

    def texts_ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of neighbouring matches."""
        if self.kept > CACHE_BYTES:
            self.words.clear()
            self.kept = 0
        own, long, rest = self.words, {}, []

        def keep(match: str, ids: tuple[int, ...]) -> None:
            packed = struct.pack(f"<{len(ids)}I", *ids)
            if len(match) <= SMALL:
                own[match] = packed
                self.kept += ENTRY_BYTES + 4 * len(match) + len(packed)
            else:
                long[match] = packed

        for match in set().union(*texts).difference(own):
            raw = match.encode()
            if raw in self.ranks:
                keep(match, (self.ranks[raw],))
            else:
                rest.append((match, raw))
        for (match, _), ids in zip(rest, self.encoded_many([raw for _, raw in rest]), strict=True):
            keep(match, ids)
        return [b"".join([own[m] if m in own else long[m] for m in t] if long else map(own.__getitem__, t)) for t in texts]


def _pieces(text: str, place) -> Iterator[str]:
    """``text`` in pieces that end between a character and the white space after it."""
    at = 0
    while len(text) - at > PIECE:
        found = place.search(text, at + PIECE)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def _rows_ids(tree: Tree, texts: pa.Array, cut, place) -> Iterator[bytes]:
    """The ids of each text; pieces of neighbouring texts of about ``PIECE`` characters are encoded together."""
    held, size, row = [], 0, []

    def told() -> Iterator[bytes]:
        for (_, ends), ids in zip(held, tree.texts_ids([matches for matches, _ in held]), strict=True):
            row.append(ids)
            if ends:
                yield b"".join(row)
                row.clear()
        held.clear()

    for text in texts:
        for piece in _pieces(text.as_py() or "", place):
            held.append([cut.findall(piece), False])
            size += len(piece)
            if size >= PIECE:
                yield from told()
                size = 0
        held.append([[], True])
    yield from told()


def encoder(spark: SparkSession, vocabulary: str, pattern: str) -> Callable[[Column | str], Column]:
    """A function from a text column to its ids. ``vocabulary`` is a rank file the driver can read (its bytes are
    broadcast: the size of a vocabulary). No match of ``pattern`` may go from another character into white space."""
    with open(vocabulary, "rb") as f:
        raw = f.read()
    sent = spark.sparkContext.broadcast((raw, pair_ranks(read_ranks(raw))))

    @F.arrow_udf("binary")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import regex

        raw, pairs = sent.value
        tree, cut, place = Tree(read_ranks(raw), pairs), regex.compile(pattern), regex.compile(r"(?<=\S)(?=\s)")
        for some in texts:
            yield pa.array(_rows_ids(tree, some, cut, place), pa.binary(), size=len(some))

    return encode


def decoder(spark: SparkSession, vocabulary: str) -> Callable[[Column | str], Column]:
    """A function from an ids column to the bytes they stand for."""
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("binary")
    def decode(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {i: token for token, i in read_ranks(sent.value).items()}.__getitem__
        for some in ids:
            yield pa.array((b"".join(map(tokens, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in some),
                           pa.binary(), size=len(some))

    return decode
