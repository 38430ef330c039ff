"""The BPE tree against the plain definition and the public library; round trips through Spark."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelscope.llm import byte_bpe

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(VOCABULARY, "rb") as f:
        return byte_bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(8)
    some = ["", " ", "\n\n  x", "don't WE'LL 's", "漢字かな交じり文" * 40, "👍🏽👩‍👩‍👧", "é́é", "\x85 \x1c.", "1234567890" * 30,
            "<|endoftext|>", "a" * 5000, "ab" * 3001, "\0\0", " " * 700 + "x"]
    some += ["".join(rnd.choice("the qu'éß漢 \n19.") for _ in range(rnd.choice([3, 40, 900]))) for _ in range(150)]
    some += [" ".join(rnd.choice(["lorem", "Straße", "l'été", "数据", "x1y2"]) for _ in range(60_000)), "z" * 300_000]
    return some


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_texts_through_spark(spark, library):
    rows = [(i, t, "x", b"y") for i, t in enumerate(odd_texts())] + [(None, None, "x", None), (1, "twice", "x", None), (1, "twice", "x", None)]
    encode, decode = byte_bpe.encoder(spark, VOCABULARY, P.PATTERN), byte_bpe.decoder(spark, VOCABULARY)
    df = spark.createDataFrame(rows, "doc_id long, text string, words string, decoded binary")
    out = df.repartition(3).select("doc_id", "text", "words", "decoded", encode("text").alias("ids"))
    out = out.select("text", "words", "ids", decode("ids").alias("back")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert ids_of(r.ids) == library.encode_ordinary(r.text or "")
        assert r.back == (r.text or "").encode() and r.words == "x"
    empty = df.limit(0).select(encode("text").alias("ids"))
    assert empty.count() == 0


@given(st.lists(st.sampled_from("ab"), min_size=1, max_size=14), st.dictionaries(
    st.text("ab", min_size=2, max_size=4), st.just(0), max_size=9))
@settings(max_examples=300, deadline=None)
def test_joining_equals_the_definition_for_any_ranks(letters, words):
    """Also for vocabularies with tokens that no merge reaches."""
    ranks = {w.encode(): i for i, w in enumerate(["a", "b", *words])}
    tree = byte_bpe.Tree(ranks)
    raw = "".join(letters).encode()
    for cut in range(1, len(raw)):
        assert tree.joined_many([(tree.merged(raw[:cut]), tree.merged(raw[cut:]))]) == [tree.merged(raw)]
    long = raw * 9
    assert tree.encoded_many([long]) == [tree.merged(long)] == [tree._merged_long(long)]
    many = [raw[i:] + raw[:j] for i in range(len(raw)) for j in range(1, len(raw))] or [raw]
    assert tree._merged_rows(many) == [tree.merged(r) for r in many]
    assert tree.encoded_many([m * 3 for m in many]) == [tree.merged(m * 3) for m in many]


def test_a_small_cache_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1000)
    tree = byte_bpe.Tree(ranks)
    import regex
    for text in odd_texts()[:80]:
        assert ids_of(tree.texts_ids([regex.findall(P.PATTERN, text)])[0]) == library.encode_ordinary(text)
    assert tree.texts_ids([]) == [] and tree.texts_ids([[], ["a"]])[0] == b""
