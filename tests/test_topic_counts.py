"""Terms are counted from one reading of the texts, and numbered tables are not computed again for their numbers."""

from pyspark.sql import functions as F

from reelscope.functions.text import strip_ws
from reelscope.operators import topics as M
from reelscope.operators.scoring import _word_alternation
from reelscope.plans.catalog import load_all

TEXTS = "movie_name string, topic long, review_text string"


def test_pairs_and_their_places_in_the_raw_text(spark):
    df = spark.createDataFrame([("m", 1, "red the car red car"), (None, 1, "red car"), ("m", 2, None), ("m", 2, " . ")], TEXTS)
    rows = M.count_ngrams(df, "review_text", ["movie_name", "topic"], ["the"]).groupBy("movie_name", "topic", "term") \
            .agg(F.sum("n").alias("n"), F.sum("n_raw").alias("raw")).collect()
    assert {tuple(r) for r in rows} == {
        ("m", 1, "red", 2, 2), ("m", 1, "car", 2, 2), ("m", 1, "red car", 2, 1), ("m", 1, "car red", 1, 1),
        (None, 1, "red", 1, 1), (None, 1, "car", 1, 1), (None, 1, "red car", 1, 1)}


def test_parts_of_a_task_count_as_the_whole(spark, monkeypatch):
    df = spark.createDataFrame([("m", i % 3, f"word{i % 5} other{i % 7} word{i % 2}") for i in range(200)], TEXTS).coalesce(1)
    count = lambda: {tuple(r) for r in M.topic_terms(df, "review_text", ["movie_name"], []).collect()}
    whole = count()
    monkeypatch.setattr(M, "COUNTED_BYTES", 40)
    assert count() == whole


def test_best_words_of_a_bin_do_not_depend_on_how_many_are_asked_for(spark):
    rows = [("m", i % 2, f"{'abc'[i % 3] * 3} word{i * i % 11} rare{i}", f"2024-01-{i * 5 % 28 + 1:02d}") for i in range(120)]
    df = spark.createDataFrame(rows, TEXTS + ", ts string").withColumn("ts", F.to_date("ts"))
    best = lambda k: {tuple(r) for r in M.topic_words_over_time(df, "review_text", ["movie_name"], "ts", [], 6, k)
                      .where("rank <= 2").collect()}
    assert best(2) == best(500)  # with 500 no bin has a floor


def test_numbering_reads_no_text_again(spark, tmp_path):
    spark.createDataFrame([(i, f"Good film number {i}. Bad end of it all. The sound was fine {i}.", "en", "s") for i in range(30)],
                          "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("A2_review_vote", "O3_sort_topics"):
        df = load_all()[name].build(spark, str(tmp_path))
        assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString(), name
        assert df.count() == (30 if name.startswith("A2") else 10)


def test_trimming_and_lexicon_without_a_walk_over_every_choice(spark):
    row = spark.createDataFrame([("　 \x1c good, goods best bests ungood GOOD \n",)], "t string").select(
        strip_ws("t").alias("s"), F.regexp_count(F.lower("t"), F.lit(_word_alternation(["good", "goo", "best"]))).alias("n")).first()
    assert tuple(row) == ("good, goods best bests ungood GOOD", 3)
    assert "regexp" not in str(strip_ws("t"))
