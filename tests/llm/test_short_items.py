"""Short benchmark items inside long documents: none may be missed."""

import random

from reelscope.llm import decontaminate


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def test_items_of_one_to_sixteen_shingles_are_found(spark):
    rnd = random.Random(21)
    word = lambda: f"v{rnd.randrange(5000)}"
    items = [(100 * size + k, " ".join(word() for _ in range(size + 4))) for size in (*range(1, 9), 12, 16, 17) for k in range(40)]
    docs = []
    for d, (_, text) in enumerate(items):
        words = [word() for _ in range(300)]
        at = rnd.randrange(300)
        docs.append((d, " ".join([*words[:at], text, *words[at:]])))
    # eight of ten shingles in two places of the document, and seven of ten
    split = [f"s{i}" for i in range(14)]
    items += [(9000, " ".join(split))]
    docs += [(9000, " ".join([*split[:8], *[word() for _ in range(200)], *split[6:]])),
             (9001, " ".join([*split[:8], *[word() for _ in range(200)], *split[7:]]))]
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    sets = [(k, shingles(t)) for k, t in items]
    want = set()
    for d, t in docs:
        s = shingles(t)
        want |= {(d, k, len(q), len(q & s)) for k, q in sets if 100 * len(q & s) >= 80 * len(q)}
    assert len(want) >= len(docs) - 1
    assert got == want
