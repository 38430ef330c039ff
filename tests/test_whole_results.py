"""The one-pass vote, lists exploded once, places, words per time bin and records as text, against small cases by hand."""

import math

import pytest
from pyspark.sql import functions as F

from reelscope.operators import disconnect as D
from reelscope.operators import ordering as O
from reelscope.operators import profile as P
from reelscope.operators import reshape as R
from reelscope.operators import scoring as SC
from reelscope.operators import sentences as S
from reelscope.operators import topics as M
from reelscope.sources import files as SF

SENTENCES = "r long, sentence_index int, sentiment_label string, sentiment_score double"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vote_reads_its_sentences_once_and_refuses_unknown_labels(spark):
    rows = [(1, 0, "neutral", 0.5), (1, 1, "positive", 0.7), (1, 2, "positive", 0.9), (2, None, None, None), (None, 0, "negative", 1.0)]
    vote = S.review_vote(spark.createDataFrame(rows, SENTENCES), ["r"], global_index=None)
    assert _plan(vote).count("Aggregate [") == 1 and "Union" not in _plan(vote) and "Join" not in _plan(vote)
    got = {r.r: (r.sentiment_label, round(r.sentiment_score, 6), r.sentence_count, dict(r.sentiment_distribution)) for r in vote.collect()}
    assert got == {1: ("positive", 0.7, 3, {"neutral": 1, "positive": 2}), 2: ("neutral", 0.0, 0, {}), None: ("negative", 1.0, 1, {"negative": 1})}
    for bad in ("angry", None):
        odd = spark.createDataFrame([(1, 0, bad, 0.5)], SENTENCES)
        with pytest.raises(Exception, match="outside the vote's labels"):
            S.review_vote(odd, ["r"], global_index=None).collect()


def test_explode_list_infers_no_filter_on_the_list(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id long, t string")
    words = F.filter(F.split("t", " "), lambda w: w != "")
    rows = R.explode_list(df, words, ["id"], "w", "at")
    assert "size(" not in _plan(rows)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, 0, "a"), (1, 1, "b")]
    kept = R.explode_list(df, words, ["id"], "w", "at", keep_empty=True)
    assert {r.id: r.w for r in kept.collect()}.keys() == {1, 2, 3}


def test_with_rank_numbers_the_whole_table(spark):
    df = spark.createDataFrame([(3, "a"), (None, "b"), (-7, "c"), (3, "A"), (1 << 40, "d")], "n long, t string")
    got = {r.t: r.rank for r in O.with_rank(df, [F.col("n"), F.col("t")]).collect()}
    assert got == {"b": 1, "c": 2, "A": 3, "a": 4, "d": 5}


def test_null_group_keeps_its_sentences(spark):
    reviews = spark.createDataFrame([("m", 1), (None, 2), (None, 3), ("none", 4)], "movie_name string, review_id long")
    sentences = spark.createDataFrame([("m",), (None,), (None,), (None,), ("stray",)], "movie_name string")
    got = {r.movie_name: (r.reviews, r.sentences) for r in S.sentences_per_review(reviews, sentences).collect()}
    assert got == {"m": (1, 1), None: (2, 3), "none": (1, 0), "ALL": (4, 4)}


def test_metadata_by_review_keeps_sentences_the_splitters_number_differently(spark):
    scored = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "review_index long, sentence_index long")
    meta = spark.createDataFrame([(1, 2, "late", 9.0), (1, 1, None, 8.0)], "review_id long, sentence_num int, username string, rating double")
    meta = meta.withColumns({"date": F.lit("2024-01-01"), "source": F.lit("rt")})
    got = sorted((r.sentence_index, r.username, r.rating) for r in D.attach_metadata(scored, meta).collect())
    assert got == [(0, "late", 8.0), (5, "late", 8.0)]
    assert [r.sentence_index for r in D.attach_metadata(scored, meta, by_position=True).collect()] == [0]


def test_words_per_bin_follow_the_recurrence(spark):
    # days 0, 1 and 3 of bins 0 to 3: bins 0 and 1 are successive, bin 3 starts afresh
    rows = [("m", 0, "apple apple pear", "2024-01-01"), ("m", 0, "plum pear", "2024-01-02"), ("m", 0, "plum", "2024-01-05"),
            ("m", 1, "fig", "2024-01-01")]
    df = spark.createDataFrame(rows, "g string, topic int, t string, day string").withColumn("ts", F.to_date("day"))
    got = {(r.topic, r.time_bin, r.term): r.score for r in M.topic_words_over_time(df, "t", ["g"], "ts", [], bins=4, k=50).collect()}
    texts = {0: "apple apple pear", 1: "plum pear", 3: "plum"}
    grams = {b: (w := t.split()) + [f"{x} {y}" for x, y in zip(w, w[1:])] for b, t in texts.items()}
    whole = sum(grams.values(), [])
    a = (len(whole) + 1) / 2
    want, before = {}, {}
    for b in (0, 1, 3):
        share = {w: grams[b].count(w) / len(grams[b]) for w in whole}
        before = {w: (share[w] + before[w]) / 2 for w in share} if b - 1 in grams else share
        for w, s in before.items():
            if s > 0:
                score = (s + whole.count(w) / len(whole)) / 2 * math.log(1 + a / whole.count(w))
                want[0, b, w] = round(score * 1e6) / 1e6
    want[1, 0, "fig"] = round(math.log(1 + a) * 1e6) / 1e6
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 2e-6 for x in want)


ODD = ['a "q" b, c\nline2\r\nline3', 'back\\slash "" end\\', " lead , trail ", '"', "\n", "#c", '\\"', "a\rb", '""', "null", None, ""]


def test_records_as_text_come_back(spark):
    df = spark.createDataFrame([(i, t, i / 3) for i, t in enumerate(ODD)], "id long, t string, x double")
    back = SF.read_json_lines(SF.json_lines(df), df.schema).collect()
    assert [(r.id, r.t, r.x, r[SF.CORRUPT]) for r in back] == [(i, t, i / 3, None) for i, t in enumerate(ODD)]
    back = SF.read_csv_lines(SF.csv_lines(df), df.schema).collect()
    assert [(r.id, r.t, r.x, r[SF.CORRUPT]) for r in back] == [(i, t or None, i / 3, None) for i, t in enumerate(ODD)]
    bad = spark.createDataFrame([("{bad",), ('{"id": 1}',)], "value string")
    assert [(r.id, r[SF.CORRUPT]) for r in SF.read_json_lines(bad, df.schema).collect()] == [(None, "{bad"), (1, None)]
    bad = spark.createDataFrame([("x,1,2",), ("1,2,3,4",)], "value string")
    assert [r[SF.CORRUPT] for r in SF.read_csv_lines(bad, df.schema).collect()] == ["x,1,2", "1,2,3,4"]


def test_profile_reads_cells_once_and_sketches_merge(spark):
    df = spark.range(0, 20000).select("id", (F.col("id") % 1000).cast("string").alias("t"),
                                      F.when(F.col("id") % 4 == 1, F.col("id") / 2).alias("x"))
    prof = P.column_profile(df, "id")
    assert "Expand" not in _plan(prof)
    got = {r.column_name: (r.total_rows, r.null_count, r.distinct_count, r["sample"]) for r in prof.collect()}
    assert got == {"id": (20000, 0, 20000, "0"), "t": (20000, 0, 1000, "0"), "x": (20000, 15000, 5000, "0.5"),
                   "*": (20000, 15000, None, None)}
    parts = [P.column_sketches(df.filter(F.col("id") % 3 == i)) for i in range(3)]
    merged = {r.column_name: r for r in P.merge_sketches(R.union_all(parts)).collect()}
    for name, (rows, nulls, distinct, _) in got.items():
        if name != "*":
            assert (merged[name].total_rows, merged[name].null_count) == (rows, nulls)
            assert abs(merged[name].distinct_estimate - distinct) <= 0.05 * distinct  # three standard errors
    assert P.column_profile(df.limit(0), "id").count() == 0


def test_labelled_rows_are_kept_and_the_rest_scored_in_one_reading(spark):
    df = spark.createDataFrame([(1, "good good", "negative", 0.25), (2, "good good", None, None), (3, " ", None, None), (4, None, "neutral", None)],
                               "id long, text string, sentiment string, confidence double")
    out = R.rescore_mode(df, 3, lambda d: SC.lexicon_scorer(d, "text"))
    assert "Union" not in _plan(out)
    got = {r.id: (r.text, r.sentiment, r.confidence is not None) for r in out.collect()}
    assert got == {1: ("good good", "negative", True), 2: ("good good", "positive", True), 3: (" ", None, False), 4: (None, "neutral", False)}
    assert [r.confidence for r in out.filter("id = 1").collect()] == [0.25]


def test_model_sees_no_empty_text_and_the_input_is_read_once(spark):
    def make():
        import numpy as np

        def predict(texts):
            assert all(str(t).strip() for t in texts)
            return np.array([[0.0, 1.0, 5.0]] * len(texts))
        return predict
    df = spark.createDataFrame([(1, "a"), (2, " \n"), (3, None), (4, "b")], "id long, t string")
    out = SC.score_sentences(df, "t", make, batch_size=2)
    assert "Union" not in _plan(out)
    assert {r.id: r.sentiment for r in out.collect()} == {1: "positive", 2: None, 3: None, 4: "positive"}


def test_topic_analysis_gates_groups_and_keeps_those_without_topics(spark):
    votes = [("a", 0, "positive")] * 3 + [("a", 1, "negative")] + [("a", -1, "neutral")] + [("b", -1, "neutral")] * 4 + [("c", 0, "positive")]
    df = spark.createDataFrame(votes, "g string, topic long, sentiment_label string").withColumns({
        "sentiment_score": F.lit(0.5), "sentence_count": F.lit(2).cast("long"),
        "sentiment_distribution": F.create_map(F.col("sentiment_label"), F.lit(2).cast("long"))})
    words = spark.createDataFrame([("a", 0, "fig", 1.0, 1)], "g string, topic long, keyword string, score double, rank long")
    got = {r.g: r for r in M.topic_analysis(M.topic_levels(df, ["g"]), ["g"], words, 4).collect()}
    assert got.keys() == {"a", "b"}  # c has one review
    a, b = got["a"], got["b"]
    assert (a.total_reviews, a.total_sentences, a.review_positive_pct, a.sentence_negative_pct, a.topics_found) == (5, 10, 60.0, 20.0, 2)
    assert (a.topic, a.topic_size, a.positive_percentage, a.dominant_sentiment, a.keyword_string) == (0, 3, 100.0, "POSITIVE", "fig")
    assert (b.total_reviews, b.topics_found, b.topic, b.topic_size, b.keyword_string) == (4, 0, None, None, None)
