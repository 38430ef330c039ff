"""Op 7's shards and their merging against sorting and counting by hand."""

import random
from collections import Counter

import numpy as np

from reelscope.llm import suffix_dedup as S


def some_contexts(seed, letters=b"ab", many=40):
    rnd = random.Random(seed)
    shared = [bytes(rnd.choices(letters, k=rnd.randrange(20, 60))) for _ in range(4)]
    return [bytes(rnd.choices(letters, k=rnd.randrange(3))) + rnd.choice(shared) + bytes(rnd.choices(letters, k=rnd.randrange(9)))
            for _ in range(many)] + [b"a" * 64, b"a" * 61]


def test_shard_sorts_every_suffix_and_steps_back():
    for letters in (b"ab", bytes(range(256))):
        contexts = some_contexts(1, letters)
        symbols, start, many = S.symbols_of(contexts)
        size = np.array([len(c) for c in contexts])
        shard = S.Shard(symbols, start, size, np.arange(len(contexts)), np.uint16)
        texts = []
        for i, c in enumerate(contexts):
            for p in range(4):
                m = max((len(c) - p) // 4, 0)
                texts += [(c[p + 4 * k:p + 4 * m], len(texts) + k, i, p + 4 * k) for k in range(m + 1)]
        want = sorted(texts)
        assert [(c, b) for _, _, c, b in want] == list(zip(shard.context.tolist(), shard.byte.tolist(), strict=True))
        place = {(c, b): k for k, (_, _, c, b) in enumerate(want)}
        assert [place.get((c, b - 4), -1) for _, _, c, b in want] == shard.back.tolist()


def test_merging_keeps_only_suffixes_with_equals():
    contexts = some_contexts(2)
    symbols, start, many = S.symbols_of(contexts)
    size, number = np.array([len(c) for c in contexts]), np.arange(len(contexts))
    shards = [S.Shard(symbols, start[a:a + 9], size[a:a + 9], number[a:a + 9], np.uint16) for a in range(0, len(contexts), 9)]
    strings = Counter(c[b:b + 20] for c in contexts for b in range(len(c) - 19))
    want = {(i, b) for i, c in enumerate(contexts) for b in range(len(c) - 19) if strings[c[b:b + 20]] > 1}
    block, context, byte = S.merged_intervals(shards, 5)
    assert len(block) == len(want) and set(zip(context.tolist(), byte.tolist(), strict=True)) == want
    found = {}
    for k, c, b in zip(block.tolist(), context.tolist(), byte.tolist(), strict=True):
        found.setdefault(k, set()).add(contexts[c][b:b + 20])
    assert all(len(v) == 1 for v in found.values()) and len(found) == len({contexts[c][b:b + 20] for c, b in want})


def test_repeats_are_those_of_plain_search():
    for seed in range(6):
        contexts = some_contexts(seed, many=60)
        doc, first = np.arange(len(contexts)) // 2, np.where(np.arange(len(contexts)) % 2, 500, 0)
        n = np.maximum(np.array([len(c) for c in contexts]) - 19, 0)
        seen, want = set(), set()
        for i, c in enumerate(contexts):
            for b in range(int(n[i])):
                want |= {(i, b)} if c[b:b + 20] in seen else set()
                seen.add(c[b:b + 20])
        context, byte = S.repeated_strings(contexts, doc, first, n, 20, shard_bytes=300)
        assert set(zip(context.tolist(), byte.tolist(), strict=True)) == want and len(context) == len(want)


def test_stable_order_of_large_numbers():
    x = np.random.default_rng(1).integers(0, 1 << 20, 5000) // 7
    assert (S.stable_order(x, 1 << 20) == np.argsort(x, kind="stable")).all()
