"""The Merkle manifest against a plain recomputation."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from reelscope.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, path int, `group` string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """The root and, per leaf, its siblings."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p - p % 3
            paths[i].append(("".join(level[first:p]), "".join(level[p + 1:first + 3])))
            at[i] = p // 3
        level = [h("".join(level[k:k + 3])) for k in range(0, len(level), 3)]
    return level[0], paths


def expected(rows):
    leaves = [(r[1], r[0], h("".join(map(told, r[:5])))) for r in rows]
    by = {}
    for source, doc_id, leaf in leaves:
        by.setdefault("" if source is None else "=" + source, []).append((doc_id is not None, doc_id, leaf))
    names = sorted(by, key=lambda s: s.encode())
    made = {g: tree([x[2] for x in sorted(by[g])]) for g in names}
    root, over = tree([made[g][0] for g in names])
    out = []
    for g, up in zip(names, over):
        for pos, (x, own) in enumerate(zip(sorted(by[g]), made[g][1])):
            out.append((x[1], g[1:] if g else None, pos, x[2], made[g][0], root, tuple(own + up)))
    return out


def odd_rows():
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "b", "é", "a", "a"]), "en", i, f"text {i}\nmore") for i in rnd.sample(range(9999), 160)]
    rows += [(None, "a", None, None, None), (None, "a", "en", 1, "x"), (None, None, None, None, None), (5, "", "", 0, ""),
             (7, "zz", "en", 10 ** 12, "w " * 200_000)]
    rows += [(12345, "a", "en", 3, "copy")] * 90 + [(4242, "b", "en", k, "same id") for k in range(40)]
    return [r + ("x", k, "y") for k, r in enumerate(rows)]


@pytest.mark.parametrize("height", [2, 5])
def test_against_a_plain_tree(spark, height):
    rows = odd_rows()
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), height=height).collect()
    found = [(r.doc_id, r.source, r.pos, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.path)) for r in got]
    assert sorted(found, key=str) == sorted(expected(rows), key=str)


def test_fold_tells_a_changed_leaf(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).withColumn("bad", F.col("doc_id") % 3 == 0)
    changed = merkle.leaf_digest([F.lit("else") if f == "text" else F.col(f) for f in merkle.FIELDS])
    out = merkle.manifest(df, carry={"bad": F.col("bad"), "node": F.when(F.col("bad"), changed)}, height=2)
    out = out.withColumn("ok", merkle.fold(F.coalesce("node", "leaf"), F.col("path")) == F.col("root"))
    assert {(bool(r.bad), r.ok) for r in out.collect()} == {(True, False), (False, True)}


def test_small_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    one = merkle.manifest(spark.createDataFrame(odd_rows()[:1], SCHEMA)).first()
    assert one.leaf == one.subroot == one.root and one.path == []
