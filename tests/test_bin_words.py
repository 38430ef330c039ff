"""M8's words per bin: only counts of words that could be among a bin's best are shuffled, and none of those is missed."""

import datetime
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reelscope.operators import topics as M

TEXTS = "g string, topic long, t string, ts date"
DAY = datetime.date(2024, 1, 1)


def _written(df):
    """Rows that the query's exchanges wrote."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind != "ReusedExchangeExec":
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def _by_hand(rows, bins, k):
    """The best words of every (group, topic, bin) without any bound."""
    rows = [(g, topic, t.split(), day.toordinal()) for g, topic, t, day in rows if g is not None]
    days = defaultdict(list)
    for g, _, _, d in rows:
        days[g].append(d)
    cells, f = defaultdict(Counter), defaultdict(Counter)
    for g, topic, w, d in rows:
        lo, width = min(days[g]), (max(days[g]) - min(days[g])) / bins
        terms = w + [f"{x} {y}" for x, y in zip(w, w[1:])]
        cells[g, topic, min(math.floor((d - lo) / width) if width else 0, bins - 1)].update(terms)
        f[g].update(terms)
    whole = defaultdict(Counter)
    for (g, topic, _), n in cells.items():
        whole[g, topic].update(n)
    best = set()
    for (g, topic), n in whole.items():
        z, a, before = n.total(), np.mean([x.total() for (h, _), x in whole.items() if h == g]), None
        for b in range(bins):
            if not (own := cells.get((g, topic, b))):
                before = None
                continue
            share = {w: own[w] / own.total() for w in n}
            before = share if before is None else {w: (share[w] + before[w]) / 2 for w in n}
            score = {w: math.floor((s + n[w] / z) / 2 * math.log(1 + a / f[g][w]) * 1e6 + 0.5) / 1e6 for w, s in before.items() if s > 0}
            if topic is not None:
                best |= {(g, topic, b, w, score[w], r) for r, w in enumerate(sorted(score, key=lambda w: (-score[w], w))[:k], 1)}
    return best


def _texts(n, seed=3):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(40)]
    for i in range(n):
        topic = r.choice([0, 0, 0, 1, None])
        some = r.choices(words, [1 / (j + 1) for j in range(40)], k=r.randint(1, 30)) + [f"rare{i}", f"odd{i % 17}"]
        # topic 1 of b has bins of its own with gaps; c lies on one day; one day holds a single short text
        g, day = r.choice("aab"), r.choice([1, 2, 3, 8, 9, 15, 29]) if topic == 1 else r.randint(0, 30)
        yield g, topic, " ".join(r.sample(some, len(some))), DAY + datetime.timedelta(day)
    yield from [("c", 0, "lonely word1", DAY), ("c", 0, "word1 word1", DAY), (None, 0, "lost", DAY), ("b", 1, "late late", DAY + datetime.timedelta(40))]


def test_words_of_a_bin_are_those_counted_by_hand(spark, monkeypatch):
    rows, partitions = [*_texts(400)], spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    best = lambda: {tuple(r) for r in M.topic_words_over_time(df, "t", ["g"], "ts", [], 6, 3).collect()}
    want = _by_hand(rows, 6, 3)
    assert best() == want
    # small parts, words left out of the seeds, terms that share their place, bins dealt to several tasks
    for name, value in (("COUNTED_BYTES", 400), ("SEED_SHARE", 100), ("MARK_BITS", 15)):
        monkeypatch.setattr(M, name, value)
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        assert best() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_only_words_that_could_be_best_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(M, "SEED_SHARE", 1000)  # for parts as small as these
    rows = [("m", i % 2, " ".join(["apple", f"fruit{i // 20 % 5}", "apple", *[f"w{i}x{j}" for j in range(36)], "pear"]), DAY + datetime.timedelta(i % 20))
            for i in range(600)]
    df = spark.createDataFrame(rows, TEXTS)
    terms = sum(2 * len(t.split()) - 1 for _, _, t, _ in rows)
    assert _written(M.topic_words_over_time(df, "t", ["g"], "ts", [], 4, 5)) < terms / 10


def test_texts_do_not_move_to_meet_their_time_range(spark):
    df = spark.createDataFrame([*_texts(10)], TEXTS)
    plan = M.time_bins(df, ["g"], "ts", 6)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_hashes_depend_on_the_word_alone():
    words = pa.array(["ab", "ba", "abc", "été", "ab c"])
    once = M._hashes(words)
    assert len({*once.tolist()}) == 5
    assert M._hashes(words.slice(2, 3)).tolist() == once[2:].tolist()
    group = np.zeros(1, np.uint64)
    place = lambda *x: int(M._places(group, *(once[i:i + 1] for i in x))[0])
    assert place(0, 1) != place(1, 0) and 0 <= place(0) < 1 << M.MARK_BITS
