"""Op 7's symbols of many bytes: few rounds over the interleave, the same repeats."""

import random

import numpy as np
import pytest
from test_interleave import some_contexts

from reelscope.llm import suffix_dedup as S


@pytest.mark.parametrize("step", [4, 5, 16, 20])
def test_symbols_name_strings_in_order(step):
    contexts = some_contexts(3) + [bytes(range(256)), b"\xff" * 30, b"\0" * 30]
    symbols, start, many = S.symbols_of(contexts, step)
    named = {c[b:b + step]: int(symbols[at + b]) for c, at in zip(contexts, start.tolist(), strict=True)
             for b in range(len(c) - step + 1)}
    order = sorted(named)
    assert [named[x] for x in order] == sorted(set(named.values())) and max(named.values()) < many
    for c, at in zip(contexts, start.tolist(), strict=True):
        assert [named[c[b:b + step]] for b in range(len(c) - step + 1)] == symbols[at:at + max(len(c) - step + 1, 0)].tolist()


def test_shard_of_wide_symbols_sorts_every_suffix():
    step, contexts = 10, some_contexts(4)
    symbols, start, many = S.symbols_of(contexts, step)
    size = np.array([len(c) for c in contexts])
    shard = S.Shard(symbols, start, size, np.arange(len(contexts)), np.uint32, step)
    texts = []
    for i, c in enumerate(contexts):
        for p in range(step):
            m = max((len(c) - p) // step, 0)
            texts += [(c[p + step * k:p + step * m], len(texts) + k, i, p + step * k) for k in range(m + 1)]
    want = sorted(texts)
    assert [(c, b) for _, _, c, b in want] == list(zip(shard.context.tolist(), shard.byte.tolist(), strict=True))
    place = {(c, b): k for k, (_, _, c, b) in enumerate(want)}
    assert [place.get((c, b - step), -1) for _, _, c, b in want] == shard.back.tolist()


@pytest.mark.parametrize("length,most", [(100, 5), (64, 4), (68, 4), (76, 4)])
def test_few_rounds_find_what_plain_search_finds(monkeypatch, length, most):
    asked, merged = [], S.merged_intervals
    monkeypatch.setattr(S, "merged_intervals", lambda shards, rounds: asked.append(rounds) or merged(shards, rounds))
    rnd = random.Random(length)
    shared = [bytes(rnd.choices(b"abc", k=150)) for _ in range(3)] + [b"ab" * 80]
    contexts = [bytes(rnd.choices(b"abc", k=rnd.randrange(50))) + rnd.choice(shared)[rnd.randrange(30):]
                + bytes(rnd.choices(b"abc", k=rnd.randrange(50))) for _ in range(40)]
    n = np.array([max(len(c) - length + 1, 0) for c in contexts])
    seen, want = set(), set()
    for i, c in enumerate(contexts):
        for b in range(int(n[i])):
            want |= {(i, b)} if c[b:b + length] in seen else set()
            seen.add(c[b:b + length])
    context, byte = S.repeated_strings(contexts, np.arange(len(contexts)), np.zeros(len(contexts), np.int64), n, length, shard_bytes=900)
    assert want and set(zip(context.tolist(), byte.tolist(), strict=True)) == want and len(context) == len(want)
    assert max(asked) <= most


def test_names_too_wide_for_one_number_sort_alike():
    rnd = np.random.default_rng(2)
    a, b = rnd.integers(0, 9, 500), rnd.integers(0, 5, 500)
    for x, y in zip(S.packed_sort([a, b], [4, 3]), S.packed_sort([a, b], [40, 40]), strict=True):
        assert (x == y).all()
    order, fresh = S.packed_sort([a, b], [4, 3])
    assert order.tolist() == sorted(range(500), key=lambda i: (a[i], b[i], i)) and fresh.sum() == len(set(zip(a.tolist(), b.tolist(), strict=True)))


def test_texts_come_in_small_batches(spark, monkeypatch, tmp_path):
    """Every step of op 7 that hands texts to Python runs under the limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcdefgh ", k=300)) for _ in range(6)]
    rows = [(i, texts[i % 6] + str(i) + texts[(i + 1) % 6][:150]) for i in range(18)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path := f"{tmp_path}/docs")
    before, seen, store = spark.conf.get(limit), [], S.stored

    def spy(df):
        if "MapInPandas" in df._jdf.queryExecution().toString():
            seen.append(spark.conf.get(limit))
        return store(df)
    monkeypatch.setattr(S, "stored", spy)
    for chunk_bytes in (2_000_000, 150):  # no hot file; hot files
        out = S.digests(S.remove_repeats(spark.read.parquet(path), chunk_bytes=chunk_bytes))
        assert "MapInPandas" not in out._jdf.queryExecution().toString() and out.where("n_removed > 0").count() > 6
    assert len(seen) == 7 and set(seen) == {"2000000"} and spark.conf.get(limit) == before
