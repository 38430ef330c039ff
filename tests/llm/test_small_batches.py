"""Steps over texts hold a bounded number of bytes at once, and give the same rows however rows are dealt."""

import random

import pandas as pd
import pytest

from reelscope.llm import decontaminate, jaccard_join, packing
from reelscope.llm.common import small_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_rows_come_in_small_batches(spark):
    texts = spark.range(400, numPartitions=1).selectExpr("id", "repeat('x', 50000) as text")  # 20 MB

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    before = spark.conf.get(LIMIT)
    with small_batches(spark):
        some = [r["n"] for r in texts.mapInPandas(sizes, "n long").collect()]
    assert sum(some) == 400 and max(some) <= 45
    assert spark.conf.get(LIMIT) == before
    with pytest.raises(ZeroDivisionError), small_batches(spark):
        raise ZeroDivisionError
    assert spark.conf.get(LIMIT) == before


def test_steps_over_texts_run_in_small_batches(spark, monkeypatch, tmp_path):
    """Every step that hands texts to Python is run under the limit."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows + [(i + 50, t) for i, t in rows], "doc_id long, text string")
    docs.write.parquet(path := f"{tmp_path}/docs")
    docs = spark.read.parquet(path)
    before, seen = spark.conf.get(LIMIT), []
    for module in (jaccard_join, decontaminate, packing):
        def spy(df, stored=module.stored, name=module.__name__.rpartition(".")[2]):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            if "text#" in plan and ("MapInPandas" in plan or "MapInArrow" in plan):
                seen.append((name, int(spark.conf.get(LIMIT).rstrip("b"))))
            return stored(df)

        monkeypatch.setattr(module, "stored", spy)
    jaccard_join.jaccard_components(docs, jaccard_join.Likeness()).collect()
    decontaminate.find_leaks(docs, docs.selectExpr("doc_id as item_id", "text")).collect()
    packing.pack_documents(docs).collect()
    assert {name for name, _ in seen} == {"jaccard_join", "decontaminate", "packing"}
    assert all(limit <= 2_000_000 for _, limit in seen), seen
    assert spark.conf.get(LIMIT) == before


def test_counts_and_keys_over_several_batches(spark):
    """Batches of three rows give the rows of one batch, for copies, near copies, and empty and null texts too."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rnd = random.Random(5)
    texts = []
    for _ in range(25):
        words = [f"w{rnd.randrange(400)}" for _ in range(60)]
        texts += [" ".join(words), " ".join(words), " ".join([*words[:-1], "other"])]
    texts += [None, "", "one two", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def told() -> list:
        return sorted(map(tuple, jaccard_join.jaccard_components(docs, jaccard_join.Likeness()).collect()))

    before, whole = spark.conf.get(rows), told()
    spark.conf.set(rows, "3")
    try:
        assert told() == whole
        sets = jaccard_join._sets_and_counts(docs, jaccard_join.Likeness()).where("token is not null")
        assert sets.count() == sets.select("token").distinct().count()  # a token's count is one row, not one a batch
    finally:
        spark.conf.set(rows, before)
    component = {r[0]: r[2] for r in whole}
    assert all(component[3 * k] == component[3 * k + 1] == component[3 * k + 2] == 3 * k for k in range(25))
    assert [component[i] for i in range(75, 79)] == [75, 76, 77, 77]
