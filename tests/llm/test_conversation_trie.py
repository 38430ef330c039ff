"""The conversation trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from reelscope.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int"


def odd_turns():
    rnd = random.Random(2)
    common = [(t, "user" if t % 2 == 0 else "assistant", f"shared turn {t} of many words") for t in range(5)]
    rows = []
    for c in range(-7, 130):
        if c % 3 == 0:
            rows += [(c, *t) for t in common]
        elif c % 11 != 5:
            rows += [(c, t, rnd.choice(["user", None, ""]), rnd.choice(["a", "b b", None, ""])) for t in range(rnd.randint(1, 6))]
    rows += [(200, None, "user", "no turn"), (200, 0, "user", "a"), (201, 1, "x", "tie"), (201, 1, "a", "tie"), (201, 1, "a", "tie")]
    rows += [(None, 0, "user", "no conversation"), (300, 0, "user", "w " * 100_000), (302, 5, "user", " \x1f w\x0bv")]
    rows += [(303, t, "user", "long") for t in range(300)]
    return [(*r, "p", 1) for r in rows]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def own_turns(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            convs.setdefault(c, []).append(((turn is not None, turn or 0, key), role, text))
    return {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in convs.items()}


def forked(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(first, [])[:h] + own[h:]
    return out


def expected(convs):
    nodes = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [total[k] for k in kids.get(p, [])]
        saved = (len(nodes[p]) - 1) * (words(p[-1][1]) if p else 0)
        total[p] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for p, cs in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        out.append((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *total[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shards,chunk", [(1, 8000), (7, 16), (60, 8000)])
def test_nodes_against_prefixes(spark, monkeypatch, shards, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = odd_turns()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = trie.trie_nodes(trie.forked_paths(df), shards)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(forked(own_turns(rows)))


def test_conversations_as_they_are_and_thin_skeleton(spark, monkeypatch):
    monkeypatch.setattr(trie, "SKELETON_TURNS", 12)
    monkeypatch.setattr(trie, "LONGEST", 4)
    rows = odd_turns()
    got = trie.trie_nodes(trie.paths(spark.createDataFrame(rows, SCHEMA)), 9)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(own_turns(rows))


def test_empty(spark):
    assert trie.trie_nodes(trie.forked_paths(spark.createDataFrame([], SCHEMA))).count() == 0
