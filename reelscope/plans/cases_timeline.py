"""Checked queries for the time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions.numbers import rating_pct
from reelscope.operators import timeline as TL
from reelscope.operators.reshape import densify_months
from reelscope.plans import views as V
from reelscope.plans.catalog import REGISTRY, oracle, register
from reelscope.plans.cases_disconnect import Z5_CTES, _z5
from reelscope.plans.cases_functions import _sql_imdb, _sql_ltbx, _sql_rt

REV = [V.SQL_V_REV]

MONTHLY_CTES = """
counts AS (SELECT movie_name, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS count,
                  avg(rating) AS avg_rating
           FROM v_rev WHERE date IS NOT NULL AND movie_name IS NOT NULL GROUP BY ALL),
bounds AS (SELECT movie_name, min(month) AS lo, max(month) AS hi FROM counts GROUP BY movie_name),
cal AS (SELECT movie_name, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM bounds),
dense AS (SELECT c.movie_name, c.month, CAST(coalesce(k.count, 0) AS BIGINT) AS count, k.avg_rating
          FROM cal c LEFT JOIN counts k USING (movie_name, month)),
labelled AS (
  SELECT *, 'Q' || CAST(quarter(month) AS VARCHAR) || ' ' || CAST(year(month) AS VARCHAR) AS qlabel,
         month(month) IN (1, 4, 7, 10) AS qstart,
         count(*) OVER (PARTITION BY movie_name) AS n_months,
         max(month) OVER (PARTITION BY movie_name) AS last_month
  FROM dense),
ticked AS (
  SELECT *, last_value(CASE WHEN qstart THEN qlabel END IGNORE NULLS) OVER (
              PARTITION BY movie_name ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_label
  FROM labelled),
series AS (
  SELECT movie_name, month, count, avg_rating,
         strftime(month, '%b %Y') AS month_name, strftime(month, '%b') AS month_short,
         year(month) AS year, month(month) AS month_num,
         CASE WHEN n_months <= 12 THEN NULL WHEN qstart THEN qlabel
              WHEN month = last_month AND (prev_label IS NULL OR prev_label <> qlabel) THEN qlabel END AS quarter_label,
         coalesce(last_value(avg_rating IGNORE NULLS) OVER (PARTITION BY movie_name ORDER BY month
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  first_value(avg_rating IGNORE NULLS) OVER (PARTITION BY movie_name ORDER BY month
                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS avg_rating_filled
  FROM ticked)
"""


def _monthly(select: str, doubles=(), dates=("month",)) -> str:
    inner = oracle("SELECT * FROM out_q", [], doubles=doubles, dates=dates)
    return "WITH " + V.SQL_V_REV + "," + MONTHLY_CTES + f", out_q AS ({select})\n" + inner


@register("A18_monthly_count", _monthly("SELECT movie_name, month, count FROM counts"))
def a18(spark, sf):
    """Reviews per movie and month (null dates not counted)."""
    return TL.monthly_count(V.v_rev(spark, sf))


@register("A19_monthly_mean", _monthly("SELECT movie_name, month, avg_rating FROM counts", doubles=("avg_rating",)))
def a19(spark, sf):
    """Mean rating per movie and month."""
    return TL.monthly_mean(V.v_rev(spark, sf), "rating", out="avg_rating")


@register("J4_densify_months", _monthly("SELECT movie_name, month, count FROM dense"))
def j4(spark, sf):
    """Every month between first and last, counts filled with 0."""
    return densify_months(TL.monthly_count(V.v_rev(spark, sf)), ["movie_name"], "month", counts=["count"])


@register("D7_quarter_label", _monthly(
    "SELECT movie_name, month, month_name, month_short, year, month_num, quarter_label FROM series"))
def d7(spark, sf):
    """D6 + D7: month labels and quarter ticks on the dense series."""
    s = TL.review_timeline(V.v_rev(spark, sf))["series"]
    return s.select("movie_name", "month", "month_name", "month_short", "year", "month_num", "quarter_label")


@register("W1_fill_gaps", _monthly("SELECT movie_name, month, avg_rating, avg_rating_filled FROM series",
                                   doubles=("avg_rating", "avg_rating_filled")))
def w1(spark, sf):
    """Monthly mean rating, forward then back filled."""
    s = TL.review_timeline(V.v_rev(spark, sf))["series"]
    return s.select("movie_name", "month", "avg_rating", "avg_rating_filled")


@register("W2_peak_month", _monthly(
    "SELECT movie_name, coalesce(max(month) FILTER (WHERE rk = 1 AND count > 0), min(month)) AS peak_month, "
    "CAST(coalesce(max(count) FILTER (WHERE count > 0), 0) AS BIGINT) AS peak_count FROM ("
    "SELECT *, row_number() OVER (PARTITION BY movie_name ORDER BY (count > 0) DESC, count DESC, month) AS rk "
    "FROM dense) GROUP BY movie_name", dates=("peak_month",)))
def w2(spark, sf):
    """Peak month per movie (first on ties)."""
    return TL.review_timeline(V.v_rev(spark, sf))["peak"]


@register("Z6_review_timeline", _monthly("SELECT * FROM series", doubles=("avg_rating", "avg_rating_filled")))
def z6(spark, sf):
    """Dense monthly series with labels, ticks, mean rating and filled mean."""
    return TL.review_timeline(V.v_rev(spark, sf))["series"]


# ------------------------------------------------------------------ daily view (Z7) on the disconnect table

def _z7(spark, sf):
    final = _z5(spark, sf)["final"]
    return TL.rating_vs_text_by_day(final, "user_rating", "mss", ["movie_name"], date="review_date")


Z7_CTES = """,
pts AS (SELECT *, CAST(floor((epoch(review_date) - epoch(min(review_date) OVER (PARTITION BY movie_name))) / 86400)
                        AS BIGINT) AS days
        FROM final WHERE review_date IS NOT NULL)"""


def _nan(e: str) -> str:
    return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} END)"


def _z7_sql(select: str, doubles=(), stamps=()) -> str:
    from reelscope.plans.cases_disconnect import _z5_sql
    inner = oracle("SELECT * FROM z7_out", [], doubles=doubles, stamps=stamps)
    return _z5_sql(Z7_CTES + f", z7_out AS ({select})\n" + inner)


_PEARSON = ("covar_pop(user_rating, mss) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL) / "
            "nullif(stddev_pop(user_rating) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL) * "
            "stddev_pop(mss) FILTER (WHERE user_rating IS NOT NULL AND mss IS NOT NULL), 0)")

Z7_SUMMARY = f"""
SELECT movie_name, min(review_date) AS first_date, max(review_date) AS last_date,
       count(DISTINCT CAST(review_date AS DATE)) AS days_with_reviews, count(*) AS reviews,
       avg(user_rating) AS mean, min(user_rating) AS min, max(user_rating) AS max,
       {_nan('regr_slope(user_rating, days)')} AS rating_slope, {_nan('regr_intercept(user_rating, days)')} AS rating_intercept,
       {_nan('regr_slope(mss, days)')} AS score_slope, {_nan('regr_intercept(mss, days)')} AS score_intercept,
       {_PEARSON} AS pearson_r,
       CASE WHEN {_PEARSON} > 0.7 THEN 'Strong positive correlation'
            WHEN {_PEARSON} > 0.3 THEN 'Moderate positive correlation'
            WHEN {_PEARSON} > -0.3 THEN 'Weak or no correlation'
            WHEN {_PEARSON} > -0.7 THEN 'Moderate negative correlation'
            ELSE 'Strong negative correlation' END AS interpretation
FROM pts GROUP BY movie_name"""


@register("Z7_rating_vs_text_by_day", _z7_sql(
    Z7_SUMMARY, doubles=("mean", "min", "max", "rating_slope", "rating_intercept", "score_slope", "score_intercept",
                         "pearson_r"), stamps=("first_date", "last_date")))
def z7(spark, sf):
    """Z7 (+ A21, A25, N15, D8): per movie the range, both trends and the correlation."""
    return _z7(spark, sf)["summary"]


@register("W3_key_points", _z7_sql("""
SELECT movie_name,
       arg_min(review_index, (review_date, review_index)) AS first_review,
       arg_max(review_index, (review_date, review_index)) AS last_review,
       arg_min(review_index, (user_rating, review_date, review_index)) FILTER (WHERE user_rating IS NOT NULL) AS lowest_review,
       arg_max(review_index, (user_rating, -epoch_us(review_date), -review_index)) FILTER (WHERE user_rating IS NOT NULL)
         AS highest_review
FROM pts GROUP BY movie_name"""))
def w3(spark, sf):
    """First, last, lowest and highest rated review per movie."""
    return _z7(spark, sf)["key_points"]


@register("W4_trend_line", _z7_sql("""
SELECT movie_name, review_index, days, user_rating,
       regr_slope(user_rating, days) OVER (PARTITION BY movie_name) * days
         + regr_intercept(user_rating, days) OVER (PARTITION BY movie_name) AS trend
FROM pts""", doubles=("user_rating", "trend")))
def w4(spark, sf):
    """The rating trend line evaluated at every review."""
    pts = _z7(spark, sf)["points"]
    return TL.trend_line(pts, "days", "user_rating", ["movie_name"]).select(
        "movie_name", "review_index", "days", "user_rating", "trend")


@register("O1_sort_by_date", _z7_sql(
    "SELECT movie_name, review_index, review_date, row_number() OVER (ORDER BY review_date NULLS LAST, review_index, "
    "movie_name NULLS FIRST) AS rank FROM final",
    stamps=("review_date",)))
def o1(spark, sf):
    """O1: reviews by date ascending, nulls last, with their place."""
    f = _z5(spark, sf)["final"].select("movie_name", "review_index", "review_date")
    return TL.sort_by_date(f, "review_date", ["review_index", "movie_name"], "rank")


# ------------------------------------------------------------------ W7 deviation series on the review view

@register("W7_deviation_series")
def w7(spark, sf):
    """Monthly mean numeric rating vs monthly mean site rating text, dense and filled."""
    r = V.v_rev(spark, sf)
    texts = r.withColumn("text_rating", rating_pct(F.col("raw_rating"), F.col("source")))
    return TL.deviation_series(r, texts, "rating", "text_rating")


REGISTRY["W7_deviation_series"].sql = (
    "WITH " + V.SQL_V_REV + f""",
a AS (SELECT movie_name, CAST(date_trunc('month', date) AS DATE) AS month, avg(rating) AS avg_rating
      FROM v_rev WHERE date IS NOT NULL AND movie_name IS NOT NULL GROUP BY ALL),
b AS (SELECT movie_name, CAST(date_trunc('month', date) AS DATE) AS month,
             avg(CASE source WHEN 'imdb' THEN {_sql_imdb('raw_rating')} WHEN 'ltbx' THEN {_sql_ltbx('raw_rating')}
                             WHEN 'rt' THEN {_sql_rt('raw_rating')} END) AS avg_score
      FROM v_rev WHERE date IS NOT NULL AND movie_name IS NOT NULL GROUP BY ALL),
both_ AS (SELECT coalesce(a.movie_name, b.movie_name) AS movie_name, coalesce(a.month, b.month) AS month,
                 a.avg_rating, b.avg_score FROM a FULL JOIN b USING (movie_name, month)),
bounds AS (SELECT movie_name, min(month) AS lo, max(month) AS hi FROM both_ GROUP BY movie_name),
cal AS (SELECT movie_name, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM bounds),
dense AS (SELECT c.movie_name, c.month, k.avg_rating, k.avg_score FROM cal c LEFT JOIN both_ k USING (movie_name, month)),
out_q AS (
  SELECT *,
    coalesce(last_value(avg_rating IGNORE NULLS) OVER (PARTITION BY movie_name ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(avg_rating IGNORE NULLS) OVER (PARTITION BY movie_name ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS avg_rating_filled,
    coalesce(last_value(avg_score IGNORE NULLS) OVER (PARTITION BY movie_name ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(avg_score IGNORE NULLS) OVER (PARTITION BY movie_name ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS avg_score_filled
  FROM dense)
""" + oracle("SELECT * FROM out_q", [], doubles=("avg_rating", "avg_score", "avg_rating_filled", "avg_score_filled"),
             dates=("month",)))

del Z5_CTES
