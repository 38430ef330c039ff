"""Checked queries for the disconnect flow (Z5: N10-N13, A1, A3, A4, A20-A24, J1-J3, J6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions.numbers import signed_score
from reelscope.operators import disconnect as D
from reelscope.plans import views as V
from reelscope.plans.catalog import oracle, register

SENT = [V.SQL_V_SENT]
BOTH = [V.SQL_V_SENT, V.SQL_V_META]

W_SQL = "(CASE sentiment_label WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -2.0 ELSE 0.0 END * sentiment_score)"

# the disconnect chain as SQL CTEs, shared by several oracles
Z5_CTES = f"""
scores AS (
  SELECT movie_name, review_index,
         coalesce(sum({W_SQL}), 0.0) AS sum_score,
         count(sentence_index) AS num_sentences,
         abs(50.0 + 50.0 / count(sentence_index) * coalesce(sum({W_SQL}), 0.0)) AS nmd_score
  FROM v_sent GROUP BY movie_name, review_index),
with_score AS (
  SELECT s.*, sc.nmd_score, sc.num_sentences
  FROM v_sent s LEFT JOIN scores sc USING (movie_name, review_index)),
combined AS (
  SELECT w.*, m.username, m.date, m.rating, m.source
  FROM with_score w JOIN v_meta m
    ON w.review_index = m.review_id AND w.sentence_index = m.sentence_num - 1),
summary AS (
  SELECT movie_name, review_index,
         arg_min(username, sentence_index) FILTER (WHERE username IS NOT NULL) AS username,
         arg_min(date, sentence_index) FILTER (WHERE date IS NOT NULL) AS review_date,
         arg_min(rating, sentence_index) FILTER (WHERE rating IS NOT NULL) AS user_rating,
         arg_min(source, sentence_index) FILTER (WHERE source IS NOT NULL) AS source,
         arg_min(nmd_score, sentence_index) FILTER (WHERE nmd_score IS NOT NULL) AS nmd_score,
         arg_min(num_sentences, sentence_index) FILTER (WHERE num_sentences IS NOT NULL) AS num_sentences
  FROM combined GROUP BY movie_name, review_index),
stats AS (
  SELECT movie_name, review_index,
         avg(sentiment_score) AS avg_sentiment_score,
         avg(CASE WHEN sentiment_label = 'positive' THEN 1.0 ELSE 0.0 END) * 100.0 AS positive_percentage
  FROM v_sent GROUP BY movie_name, review_index),
review_scores AS (
  SELECT su.movie_name, su.review_index, su.username, su.review_date, su.user_rating, su.source,
         su.num_sentences, sc.sum_score, su.nmd_score, st.avg_sentiment_score, st.positive_percentage
  FROM summary su
  LEFT JOIN scores sc USING (movie_name, review_index)
  LEFT JOIN stats st USING (movie_name, review_index)),
final AS (
  SELECT movie_name, review_index, username, review_date, user_rating, source, num_sentences, sum_score,
         nmd_score AS mss, avg_sentiment_score, positive_percentage,
         abs(nmd_score - user_rating) AS nmd_difference,
         CASE WHEN abs(nmd_score - user_rating) <= 10 THEN 'Low Significance'
              WHEN abs(nmd_score - user_rating) <= 25 THEN 'Moderate Significance'
              ELSE 'High Significance' END AS significance_category
  FROM review_scores),
sig_table AS (
  SELECT movie_name, significance_category,
         CASE significance_category WHEN 'Low Significance' THEN '0-10%'
              WHEN 'Moderate Significance' THEN '11-25%' WHEN 'High Significance' THEN '> 25%' END
           AS nmd_magnitude_range,
         round_even(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY movie_name) * 100.0 * 100.0, 0)
           / 100.0 AS percentage,
         round_even(covar_pop(user_rating, mss) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL)
           / nullif(stddev_pop(user_rating) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL)
                  * stddev_pop(mss) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL), 0) * 100.0, 0)
           / 100.0 AS pearson_r,
         count(*) AS n_reviews
  FROM final GROUP BY movie_name, significance_category)
"""


def _z5_sql(select: str) -> str:
    return "WITH " + ",\n".join(BOTH) + "," + Z5_CTES + select


def _z5(spark, sf):
    return D.narrative_metric_disconnect(V.v_sent(spark, sf), V.v_meta(spark, sf), by_position=True)


SENT_COLS = ["movie_name", "review_index", "sentence_index", "sentiment_label", "sentiment_score"]


@register("N10_signed_score", oracle(
    f"SELECT movie_name, review_index, sentence_index, sentiment_label, {W_SQL} AS x FROM v_sent",
    SENT, doubles=("x",)))
def n10(spark, sf):
    """Signed sentence score."""
    s = V.v_sent(spark, sf)
    return s.select("movie_name", "review_index", "sentence_index", "sentiment_label",
                    signed_score("sentiment_label", "sentiment_score").alias("x"))


@register("A1_review_sentiment_score")
def a1(spark, sf):
    """A1 + N11: per-review sum of signed scores, count and review score."""
    return D.review_sentiment_score(V.v_sent(spark, sf))


@register("J1_attach_review_score")
def j1(spark, sf):
    """Review score and count back on every sentence (LEFT join)."""
    s = V.v_sent(spark, sf).select(*SENT_COLS)
    return D.attach_review_score(s, D.review_sentiment_score(s))


@register("J2_attach_metadata")
def j2(spark, sf):
    """Scored sentences INNER JOIN sentence metadata by (review, position)."""
    s = V.v_sent(spark, sf).select(*SENT_COLS)
    return D.attach_metadata(s, V.v_meta(spark, sf), by_position=True)


@register("J2_attach_metadata_by_review")
def j2_review(spark, sf):
    """J2 (the default): scored sentences with their review's first known metadata."""
    s = V.v_sent(spark, sf).select(*SENT_COLS)
    return D.attach_metadata(s, V.v_meta(spark, sf))


@register("A3_review_sentence_stats")
def a3(spark, sf):
    """A3: mean score and positive share per review."""
    return D.review_sentence_stats(V.v_sent(spark, sf))


@register("A4_review_summary")
def a4(spark, sf):
    """A4: first non-null field values per review, in sentence order."""
    s = V.v_sent(spark, sf).select(*SENT_COLS)
    scores = D.review_sentiment_score(s)
    return D.review_summary(D.attach_metadata(D.attach_review_score(s, scores), V.v_meta(spark, sf), by_position=True))


@register("J3_merge_review_metrics")
def j3(spark, sf):
    """J3 + P1: the review score table (Z5's first output)."""
    return _z5(spark, sf)["review_scores"]


@register("N13_significance")
def n13(spark, sf):
    """N12 + N13: final table with mss, gap and significance band."""
    return _z5(spark, sf)["final"]


@register("A20_pearson")
def a20(spark, sf):
    """Pearson r of rating vs mss per movie, and per movie and band."""
    final = _z5(spark, sf)["final"]
    overall = D.pearson(final, "user_rating", "mss", ["movie_name"]).withColumn(
        "significance_category", F.lit("All"))
    per = D.pearson(final, "user_rating", "mss", ["movie_name", "significance_category"])
    return overall.unionByName(per)


@register("A22_category_share")
def a22(spark, sf):
    """Share of reviews per significance band, per movie."""
    return D.category_share(_z5(spark, sf)["final"], "significance_category", ["movie_name"])


@register("A23_significance_table")
def a23(spark, sf):
    """A23 + J6 + N14: band, magnitude range, share and r per movie."""
    return _z5(spark, sf)["table"]


@register("A24_relationship_collapse")
def a24(spark, sf):
    """Does the High band lose the rating/text relation (r < 0.2)?"""
    return _z5(spark, sf)["collapse"]


# ---- oracles that use the shared chain
from reelscope.plans.catalog import REGISTRY  # noqa: E402

_PEARSON = ("covar_pop(user_rating, mss) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL) / "
            "nullif(stddev_pop(user_rating) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL) * "
            "stddev_pop(mss) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL), 0)")


def _wrap(select: str, doubles=(), stamps=()) -> str:
    inner = oracle("SELECT * FROM z5_out", [], doubles=doubles, stamps=stamps)
    return _z5_sql(f", z5_out AS ({select})\n{inner}")


REGISTRY["A1_review_sentiment_score"].sql = _wrap(
    "SELECT * FROM scores", doubles=("sum_score", "nmd_score"))
REGISTRY["J1_attach_review_score"].sql = _wrap(
    "SELECT movie_name, review_index, sentence_index, sentiment_label, sentiment_score, nmd_score, num_sentences "
    "FROM with_score", doubles=("sentiment_score", "nmd_score"))
REGISTRY["J2_attach_metadata"].sql = _wrap(
    "SELECT movie_name, review_index, sentence_index, sentiment_label, sentiment_score, username, date, rating, "
    "source FROM combined", doubles=("sentiment_score", "rating"), stamps=("date",))
REGISTRY["J2_attach_metadata_by_review"].sql = _wrap(
    "SELECT w.movie_name, w.review_index, w.sentence_index, w.sentiment_label, w.sentiment_score, m.username, m.date, m.rating, "
    "m.source FROM with_score w JOIN (SELECT review_id, "
    + ", ".join(f"arg_min({c}, sentence_num) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("username", "date", "rating", "source"))
    + " FROM v_meta GROUP BY review_id) m ON m.review_id = w.review_index",
    doubles=("sentiment_score", "rating"), stamps=("date",))
REGISTRY["A3_review_sentence_stats"].sql = _wrap(
    "SELECT * FROM stats", doubles=("avg_sentiment_score", "positive_percentage"))
REGISTRY["A4_review_summary"].sql = _wrap(
    "SELECT * FROM summary", doubles=("user_rating", "nmd_score"), stamps=("review_date",))
REGISTRY["J3_merge_review_metrics"].sql = _wrap(
    "SELECT * FROM review_scores",
    doubles=("user_rating", "sum_score", "nmd_score", "avg_sentiment_score", "positive_percentage"),
    stamps=("review_date",))
REGISTRY["N13_significance"].sql = _wrap(
    "SELECT * FROM final",
    doubles=("user_rating", "sum_score", "mss", "avg_sentiment_score", "positive_percentage", "nmd_difference"),
    stamps=("review_date",))
REGISTRY["A20_pearson"].sql = _wrap(
    f"SELECT movie_name, {_PEARSON} AS pearson_r, count(*) AS n_rows, 'All' AS significance_category "
    f"FROM final GROUP BY movie_name UNION ALL "
    f"SELECT movie_name, {_PEARSON} AS pearson_r, count(*) AS n_rows, significance_category "
    f"FROM final GROUP BY movie_name, significance_category", doubles=("pearson_r",))
REGISTRY["A22_category_share"].sql = _wrap(
    "SELECT movie_name, significance_category, count(*) AS n, "
    "CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY movie_name) * 100.0 AS percentage "
    "FROM final GROUP BY movie_name, significance_category", doubles=("percentage",))
REGISTRY["A23_significance_table"].sql = _wrap("SELECT * FROM sig_table", doubles=("percentage", "pearson_r"))
REGISTRY["A24_relationship_collapse"].sql = _wrap(
    "SELECT movie_name, max(CASE WHEN significance_category = 'High Significance' THEN pearson_r END) AS high_r, "
    "CASE WHEN NOT bool_or(significance_category = 'High Significance') THEN true "
    "ELSE coalesce(max(CASE WHEN significance_category = 'High Significance' THEN pearson_r END) < 0.2, false) "
    "END AS collapse FROM sig_table GROUP BY movie_name", doubles=("high_r",))
