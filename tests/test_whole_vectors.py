"""M1 returns the vectors themselves: every weight over the true vocabulary, against a count by hand."""

import math
from collections import Counter

import __spark_entry__ as E
from conftest import SMALL_SF
from reelscope.functions.text import tokens
from reelscope.plans import views as V


def test_m1_returns_every_weight(spark):
    rows = E.queries()["M1_embed"](spark, SMALL_SF).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    docs = {r[0]: Counter(r[1] or []) for r in V.v_doc(spark, SMALL_SF).select("doc_id", tokens("text")).collect()}
    held = Counter(t for c in docs.values() for t in c)
    want = {}
    for d, c in docs.items():
        w = {t: n * math.log((1 + len(docs)) / (1 + held[t])) for t, n in c.items() if held[t] < len(docs)}
        length = math.sqrt(sum(x * x for x in w.values()))
        if w:
            want[d] = {t: x / length for t, x in w.items()}
    assert {d: set(v) for d, v in got.items()} == {d: set(v) for d, v in want.items()}
    assert len(rows) == sum(map(len, got.values()))
    # registered queries give doubles to six digits
    assert all(math.isclose(x, want[d][t], abs_tol=1e-6) for d, v in got.items() for t, x in v.items())
