"""DataFrame operators on small handwritten tables: the traps of the survey's build notes."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reelscope.operators import disconnect as D
from reelscope.operators import pages as X
from reelscope.operators import reshape as R
from reelscope.operators import sentences as S
from reelscope.operators import timeline as TL
from reelscope.operators import topics as M
from reelscope.operators.ordering import ordered_index


def test_dedup_keep_first_nulls_equal(spark):
    df = spark.createDataFrame([("a", None, 3, "x"), ("a", None, 1, "y"), ("b", "t", 2, "z"), ("b", "t", 5, "w")],
                               "u string, t string, o int, v string")
    got = sorted((r.u, r.v) for r in R.dedup_keep_first(df, ["u", "t"], "o").collect())
    assert got == [("a", "y"), ("b", "z")]


def _row_numbers(df, keys, order):
    return df.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


@pytest.mark.parametrize("order", ["o", "t", "d", "s"])
def test_ordered_index_matches_row_number_on_skew(spark, order):
    # one key, which may be null, holds most of the rows; values dense, sparse, negative and null
    rnd = random.Random(1)
    rows = [(None if i % 10 else f"k{i % 7}", rnd.choice([i, i << 40, -i, -(i << 50), 5, None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, u long").withColumns({
        "t": F.timestamp_micros(F.col("o") % 10**15), "d": F.date_add(F.lit("2020-01-01"), (F.col("o") % 9999).cast("int")),
        "s": F.when(F.col("o") % 3 != 0, F.concat(F.lit("é"), F.col("o").cast("string")))})
    got = ordered_index(df, ["k"], [order, "u"], out="idx", bucket_bits=4)
    want = _row_numbers(df, ["k"], [order, "u"])
    assert sorted(map(tuple, got.select("u", "idx").collect())) == sorted(map(tuple, want.select("u", "idx").collect()))


def test_ordered_index_of_one_key_spans_tasks_and_starts_no_job(spark):
    df = spark.range(40_000).select((F.col("id") * 0).alias("k"), "id")
    spark.sparkContext.setJobGroup("numbering", "build")
    got = ordered_index(df, ["k"], ["id"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("numbering")
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c) for c in small}
    try:
        for c, value in small.items():
            spark.conf.set(c, value)
        rows = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert len(rows) > 3 and max(r["count"] for r in rows) < 30_000
    assert got.where("idx <> id").count() == 0
    with pytest.raises(TypeError):
        ordered_index(df.withColumn("x", F.lit(0.5)), ["k"], ["x"])


def test_cap_per_group_exact(spark):
    df = spark.createDataFrame([("g", i) for i in range(100)] + [("h", 1)], "g string, o int")
    got = R.cap_per_group(df, ["g"], 80, ["o"])
    assert got.filter("g = 'g'").count() == 80 and got.filter("g = 'h'").count() == 1
    assert got.agg(F.max("o")).first()[0] == 79


def test_split_punct_numbers_keep_gaps(spark):
    df = spark.createDataFrame([(1, "Great. Bad! Very good film?? ok..."), (2, "nan"), (3, "")], "id long, t string")
    got = [(r.id, r.sentence_num, r.sentence) for r in
           S.split_sentences_punct(df, text="t").orderBy("id", "sentence_num").collect()]
    assert got == [(1, 3, "Very good film")]


def test_split_boundary_and_placeholder(spark):
    df = spark.createDataFrame([(1, "The film was long. But it was worth it!"), (2, "ok")], "id long, t string")
    got = S.split_sentences_boundary(df, text="t", keep_empty=True).orderBy("id", "sentence_index").collect()
    assert [(r.id, r.sentence_index, r.sentence_text) for r in got] == [
        (1, 0, "The film was long."), (1, 1, "But it was worth it!"), (2, None, None)]


def test_review_vote_tie_goes_to_first_label(spark):
    rows = [(1, 0, "negative", 0.9, 0), (1, 1, "positive", 0.8, 1), (1, 2, "positive", 0.7, 2),
            (1, 3, "negative", 0.6, 3), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "r long, sentence_index int, sentiment_label string, sentiment_score double, "
                                     "global_index long")
    got = {r.r: r for r in S.review_vote(df, ["r"]).collect()}
    assert got[1].sentiment_label == "negative" and got[1].sentence_count == 4
    assert got[1].sentence_indices == [0, 1, 2, 3]
    assert dict(got[1].sentiment_distribution) == {"negative": 2, "positive": 2}
    assert (got[2].sentiment_label, got[2].sentence_count, got[2].sentiment_score) == ("neutral", 0, 0.0)


def test_pearson_constant_column_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, 5.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, None)],
                               "g string, x double, y double")
    got = {r.g: r.pearson_r for r in D.pearson(df, "x", "y", ["g"]).collect()}
    assert got["a"] is None and abs(got["b"] - 1.0) < 1e-12 and got["c"] is None


def test_densify_and_fill_gaps(spark):
    rows = [("m", dt.date(2024, 1, 1), 2, 50.0), ("m", dt.date(2024, 4, 1), 1, 70.0)]
    series = spark.createDataFrame(rows, "movie_name string, month date, count long, avg_rating double")
    dense = R.densify_months(series, ["movie_name"], "month", counts=["count"], means=["avg_rating"])
    filled = TL.fill_gaps(dense, ["avg_rating"]).orderBy("month").collect()
    assert [r["count"] for r in filled] == [2, 0, 0, 1]
    assert sum(r["count"] for r in filled) == 3
    fcol = [c for c in filled[0].asDict() if c.startswith("avg_rating") and c != "avg_rating"]
    vals = [r[fcol[0]] if fcol else r.avg_rating for r in filled]
    assert vals == [50.0, 50.0, 50.0, 70.0]


def test_days_since_first_floors_elapsed_time(spark):
    from reelscope.functions.dates import days_since_first
    rows = [("m", dt.datetime(2024, 1, 1, 23, 0)), ("m", dt.datetime(2024, 1, 2, 22, 0)),
            ("m", dt.datetime(2024, 1, 3, 0, 0))]
    df = spark.createDataFrame(rows, "movie_name string, date timestamp_ntz")
    got = [r.d for r in days_since_first(df, "movie_name", "date", "d").orderBy("date").collect()]
    assert got == [0, 0, 1]


def test_topic_keywords_formula(spark):
    terms = spark.createDataFrame([("m", 0, "good", 3), ("m", 0, "film", 1), ("m", 1, "film", 2), ("m", 1, "bad", 2)],
                                  "movie_name string, topic int, term string, n long")
    got = {(r.topic, r.keyword): r.score for r in M.topic_keywords(terms, ["movie_name"], 2).collect()}
    a = 4.0  # mean words per topic
    assert math.isclose(got[(0, "good")], round(3 / 4 * math.log(1 + a / 3), 6), abs_tol=1e-9)
    assert math.isclose(got[(1, "bad")], round(2 / 4 * math.log(1 + a / 2), 6), abs_tol=1e-9)


def test_topic_terms_do_not_depend_on_the_number_of_documents(spark):
    def terms(n):
        docs = spark.range(n).select(F.lit("m").alias("movie_name"), (F.col("id") % 9).alias("topic"),
                                     F.concat(F.lit("common word"), (F.col("id") % 9).cast("string")).alias("text"))
        return {(r.topic, r.term) for r in M.topic_terms(docs, "text", ["movie_name"], []).collect()}
    assert terms(180) == terms(20_000) != set()


def test_unique_reviews_compares_whole_columns(spark):
    long = "x" * 150
    rows = [("f", "a_b", "c", long + "1", 1), ("f", "a_b", "c", long + "2", 2), ("f", "a", "b_c", long + "1", 3),
            ("f", None, "c", "t", 4), ("f", None, "c", "t", 5), ("f", "c", None, "t", 6)]
    df = spark.createDataFrame(rows, "flt string, name string, date string, text string, n int")
    assert sorted(r.n for r in R.unique_reviews(df, "flt", "name", "date", "text", "n").collect()) == [1, 2, 3, 4, 6]


PAGES = [
    (1, "https://x.example.com/en/1?ref=a",
     '<html lang="en"><body><article><h1>T1</h1><p><b>Ann, great.<br><p>Loved it &amp; more</p>'
     '<p>Second &lt;one&gt;</p></article></body></html>'),
    (2, "https://x.example.com/fr/2",
     '<div class="review-row"><span class="review-text">Top</span><time datetime="2024-01-02">x</time></div>'
     '<p>ignored</p>'),
    (3, "https://x.example.com/en/3", "<p>No audience reviews found</p>"),
    (4, "https://x.example.com/en/4", "<div>nothing</div>"),
]


def test_pages_collect_reviews(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rules = {
        "Review Content": (['<span class="review-text">([^<]*)</span>', "<br><p>([^<]+)", "^([^<]+)"],
                           X.DEFAULTS["Review Content"]),
        "Name": (['data-name="([^"]*)"', "^<b>([^<.,]+)[.,]"], X.DEFAULTS["Name"]),
        "Date": (['<time datetime="([^"]+)"'], X.DEFAULTS["Date"]),
    }
    typ = F.when(F.col("url").contains("ref="), "Critic").otherwise("Audience")
    flt = F.regexp_extract("url", "^https?://[^/]+/([^/?#]+)", 1)
    out = X.collect_reviews(pages, ['(?s)<div class="review-row">(.*?)</div>', "(?s)<p>(.*?)</p>"], rules, typ, flt)
    got = sorted((r.page_id, r.item_index, r["Review Content"], r.Name, r.Date, r.Type) for r in out.collect())
    assert got == [(1, 0, "Loved it & more", "Ann", "No Date", "Critic"),
                   (1, 1, "Second <one>", "Anonymous", "No Date", "Critic"),
                   (2, 0, "Top", "Anonymous", "2024-01-02", "Audience")]
    counts = {r.Type: r.reviews for r in X.type_counts(out).collect()}
    assert counts == {"Critic": 2, "Audience": 1}


def test_audience_rating_and_profile_name(spark):
    df = spark.createDataFrame([("4.5", None, "/profiles/jo_b/x"), ("abc", " Kim ", "/u/1"), ("", "", "")],
                               "s string, n string, h string")
    got = df.select(X.audience_rating(F.col("s")).alias("r"), X.profile_name(F.col("n"), F.col("h")).alias("p")).collect()
    assert [(r.r, r.p) for r in got] == [("4.5/5", "jo_b"), ("abc/5", "Kim"), (None, None)]
