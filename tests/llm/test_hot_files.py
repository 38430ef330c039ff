"""Passage dedup: one short passage in many surroundings is one file with many distinct contexts."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from reelscope.llm import suffix_dedup


def brute(texts):
    seen, want = set(), {}
    for d, t in sorted(texts.items()):
        raw = t.encode()
        cut = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                cut[i + 1:i + 101] = True
            seen.add(raw[i:i + 100])
        kept = bytes(b for b, c in zip(raw, cut[1:], strict=False) if not c)
        want[d] = (len(raw), len(raw) - len(kept), int((cut[1:] & ~cut[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return want


def check(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = suffix_dedup.digests(suffix_dedup.remove_repeats(docs, **options)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute(texts)


def surroundings():
    rnd = random.Random(31)
    letters = "abcdefghijklmnopqrstuvwxyz    "
    draw = lambda n: "".join(rnd.choices(letters, k=n))
    passages = {n: draw(n) for n in (99, 100, 101, 130, 170)}
    texts = {i: draw(rnd.randrange(90)) + passages[(99, 100, 101, 130, 170)[i % 5]] + draw(rnd.randrange(90)) for i in range(250)}
    texts[300] = draw(60) + passages[130] + draw(5) + passages[130] + passages[170] + draw(60)
    return texts


def test_many_contexts_of_one_file(spark):
    texts = surroundings()
    check(spark, texts, chunk_bytes=2_000)
    check(spark, texts)


def test_a_task_holds_no_hot_file(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(suffix_dedup, "_closer", lambda df, *a, f=suffix_dedup._closer: (asked.append(df), f(df, *a))[1])
    docs = spark.createDataFrame(list(surroundings().items()), "doc_id long, text string")
    suffix_dedup.remove_repeats(docs, chunk_bytes=2_000).count()
    sizes = asked[0].groupBy("file").agg(F.sum(F.octet_length("raw")).alias("bytes")).collect()
    assert max((r["bytes"] for r in sizes), default=0) <= 2_000
