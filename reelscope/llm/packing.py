"""Best-fit packing of tokenised documents into sequences of bounded length.

Tokenising: the vocabulary drops white space and never merges across it, so a text is cut at ASCII
white space; the distinct words of a piece of text are put together from cached parts (ASCII and Latin letters) or
tokenised whole, in bounded caches that end with the task. The ids are joined as little-endian 32-bit bytes. Each document ends with ``end_id``. Documents longer than ``capacity`` are cut into pieces of
``capacity`` ids; the last piece may be shorter.

Packing: the pieces (a few numbers each, no ids) are stored, dealt out evenly, sorted by falling length in each
task, and placed online by best fit: a bitset keyed by free space gives the open bin with the least
space that is enough. At most ``open_bins`` bins are open; when one more is needed, the fullest closes.
A task's memory is bounded by that number. The order is a total one, so a repeated task packs alike.

Null and empty texts are documents of one id. Repeated rows are packed each. Empty input gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import no_null, null_again, small_batches, stored, text_batches

WORD_CACHE = 100_000
PART_CACHE = 250_000
LONG = 1_000_000
TEXT_BYTES = 2_000_000
TEXT_ROWS = 1_000
BETWEEN = (1 << 32) - 1
WORD_END = "</w>"
SPECIAL = "<|"
#: Letters of one code point each whose lower case is one too: Latin-1 and Latin Extended-A but for U+0130.
LATIN_LETTERS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
LATIN = f"[\\x00-\\x7f{LATIN_LETTERS}]+"
#: Byte-level vocabularies write a byte that is no visible letter as the next free letter from U+0100 on.
LETTERS = dict(zip([b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)], range(0x100, 0x200)))
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """The ids of words. Words of ASCII and plain Latin letters are cut, all of a batch in one pass, into the parts that the
    vocabulary's own pattern makes, and put together from the parts' ids; any other word is tokenised whole. The ids of
    parts and of other words are kept until there are more than ``PART_CACHE`` or ``WORD_CACHE``."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.parts: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        pattern = parts_pattern(json.loads(tokenizer.to_str()))
        self.pattern = pattern and re.compile(pattern.format(latin=LATIN_LETTERS) + r"|\n", re.ASCII)

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        for at in range(0, len(words), 10_000):
            for e in self.tokenizer.encode_batch_fast(words[at:at + 10_000], add_special_tokens=False):
                yield np.asarray(e.ids, "<u4").tobytes()

    def _learn_parts(self, new: list[str]) -> None:
        """A part is what the vocabulary's model itself is given: its bytes, each as one letter."""
        tokenize = self.tokenizer.model.tokenize
        for part in new:
            letters = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(LETTERS)
            ids = [t.id for t in tokenize(letters)]
            self.parts[part] = struct.pack(f"<{len(ids)}I", *ids)

    def _by_parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words and the number of each word's; words are told apart by a line end in between."""
        cut = self.pattern.findall("\n".join(words.to_numpy(zero_copy_only=False)).lower())
        if len(self.parts) > PART_CACHE:
            self.parts.clear()
        self.parts["\n"] = BETWEEN.to_bytes(4, "little")
        self._learn_parts(list(set(cut).difference(self.parts)))
        ids = np.frombuffer(b"".join(map(self.parts.__getitem__, cut)), "<u4")
        between = ids == BETWEEN
        return ids[~between], np.diff(np.concatenate([[-1], np.flatnonzero(between), [len(ids)]])) - 1

    def _by_word(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = found.to_pylist()
        if len(self.others) > WORD_CACHE:
            self.others.clear()
        new = [w for w in words if w not in self.others]
        self.others.update(zip(new, self._whole(new), strict=True))
        own = [self.others[w] for w in words]
        return np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) >> 2

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, and each word's first place and number there."""
        plain = np.zeros(len(words), bool)
        if self.pattern:
            plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False).copy()
            rest = np.flatnonzero(~plain)
            plain[rest] = pc.match_substring_regex(words.take(pa.array(rest)), f"^{LATIN}$").to_numpy(zero_copy_only=False)
            plain &= ~pc.match_substring(words, SPECIAL).to_numpy(zero_copy_only=False)
        flat, first, number, base = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        for at, how in ((np.flatnonzero(plain), self._by_parts), (np.flatnonzero(~plain), self._by_word)):
            if len(at):
                ids, counts = how(words.take(pa.array(at)))
                number[at], first[at] = counts, base + np.cumsum(counts) - counts
                flat.append(ids)
                base += len(ids)
        return np.concatenate(flat) if flat else np.empty(0, "<u4"), first, number

    def texts(self, raws: list[bytes]) -> Iterator[bytes]:
        """The ids of each text. Words are numbered by Arrow, ``LONG`` at a time, and only distinct ones looked up."""
        split = pc.ascii_split_whitespace(pa.array(raws, pa.large_binary()).cast(pa.large_string()))
        flat, made, counts = split.flatten(), [], []
        for at in range(0, len(flat), LONG):
            coded = flat.slice(at, LONG).dictionary_encode()
            ids, first, number = self.of(coded.dictionary)
            index = coded.indices.to_numpy()
            count = number[index]
            take = np.repeat(first[index] - (np.cumsum(count) - count), count)
            take += np.arange(len(take))
            made.append(ids[take])
            counts.append(count)
        ids = np.concatenate(made) if made else np.empty(0, "<u4")
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))[split.offsets.to_numpy()]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()


def parts_pattern(definition: dict) -> str | None:
    """The pattern that cuts a lower-cased word into the parts the vocabulary never merges across, with
    ``{latin}`` for letters beyond ASCII; None if the vocabulary is not of that kind (lower case; matches
    of one pattern, then bytes; word ends)."""
    try:
        normal = [n["type"] for n in definition["normalizer"]["normalizers"]]
        cut, then = definition["pre_tokenizer"]["pretokenizers"]
        ours = (normal == ["NFC", "Replace", "Lowercase"] and cut["type"] == "Split" and cut["invert"]
                and cut["behavior"] == "Removed" and then["type"] == "ByteLevel" and not then["add_prefix_space"]
                and not then["use_regex"] and definition["model"]["end_of_word_suffix"] == WORD_END
                and all(t["content"].startswith(SPECIAL) for t in definition["added_tokens"]))
        pattern = cut["pattern"]["Regex"]
        if not ours or "{" in pattern.replace(r"\p{L}", "").replace(r"\p{N}", ""):
            return None
        return pattern.replace(r"\p{L}", "a-zA-Z{latin}").replace(r"\p{N}", "0-9")
    except (KeyError, TypeError, ValueError):
        return None


def tokenize_pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``. ``vocabulary`` is a tokenizer file every worker can
    read; None takes the installed public one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = WordIds(Tokenizer.from_file(path))
        kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        tail, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):  # only these rows' texts are Python's at once
                some = batch.slice(at, TEXT_ROWS)
                doc_ids, out = some.column("doc_id").to_pylist(), []
                for first, raws in text_batches(some.column("text").to_pylist(), TEXT_BYTES):
                    for doc_id, raw in zip(doc_ids[first:first + len(raws)], ids.texts(raws), strict=True):
                        raw += tail
                        for k, start in enumerate(range(0, len(raw), step)):
                            cut = raw[start:start + step]
                            out.append((doc_id, k, start // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], kinds.names)
            pa.default_memory_pool().release_unused()

    out = docs.select(no_null("doc_id"), "text").mapInArrow(run, PIECES)
    return out.withColumn("doc_id", null_again("doc_id"))


class OpenBins:
    """The open bins of one task: a bitset of the free spaces that occur, and the bins of each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.bits = capacity, most, 0, 0
        self.bins: dict[int, list[int]] = {}
        self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, place in it) for a piece; the fullest bin that still has room, else a new one."""
        found = self.bits >> length
        if found:
            free = length + (found & -found).bit_length() - 1
            name = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            name, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.bins.setdefault(left, []).append(name)
            self.bits |= 1 << left
            self.open += 1
        return name, self.capacity - free

    def _take(self, free: int) -> int:
        name = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return name


def pack_pieces(pieces: DataFrame, capacity: int = 4096, open_bins: int = 4096) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        own, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 36
        for batch in batches:
            placed = [own.place(n) for n in batch["length"].tolist()]
            batch["sequence_id"] = [base + p[0] for p in placed]
            batch["offset"] = [p[1] for p in placed]
            yield batch

    dealt = pieces.select(no_null("doc_id"), *names[1:]).hint("rebalance")
    order = [F.col("length").desc(), *[F.col(c) for c in names if c != "length"]]
    out = dealt.sortWithinPartitions(*order).mapInPandas(run, PIECES + ", sequence_id long, offset long")
    return out.withColumn("doc_id", null_again("doc_id"))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, capacity: int = 4096,
                   open_bins: int = 4096) -> DataFrame:
    with small_batches(docs.sparkSession):
        pieces = stored(tokenize_pieces(docs, vocabulary, end_id, capacity))
    return pack_pieces(pieces, capacity, open_bins)
