"""Time series of reviews: monthly volume and means, dense calendars, gap filling, peaks,
daily trends and key points (A18, A19, A21, A25, W1-W7, O1, Z6, Z7 of the survey).

Monthly and per-group tables are small (one row per group and month), so their windows
are partitioned by the group and cheap; the review-level work is aggregates and
equi-joins on the group key (``min_by``/``max_by`` for the "first/last/lowest" points,
``regr_slope``/``regr_intercept`` for the trend), never a global ordering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelscope.operators.ordering import with_rank
from reelscope.functions.dates import days_since_first, month_of, month_parts, quarter_label
from reelscope.operators.reshape import densify_months


def monthly_count(df: DataFrame, key: str = "movie_name", date: str = "date") -> DataFrame:
    """Reviews per group and month; rows without a date (or group) are not counted."""
    return (df.filter(F.col(date).isNotNull() & F.col(key).isNotNull())
              .groupBy(key, month_of(date).alias("month")).agg(F.count(F.lit(1)).alias("count")))


def monthly_mean(df: DataFrame, col: str, key: str = "movie_name", date: str = "date",
                 out: str | None = None) -> DataFrame:
    """Mean of ``col`` per group and month (months with only null values give null)."""
    return (df.filter(F.col(date).isNotNull() & F.col(key).isNotNull())
              .groupBy(key, month_of(date).alias("month")).agg(F.avg(col).alias(out or f"avg_{col}")))


def fill_gaps(series: DataFrame, cols: list[str], key: str = "movie_name", month: str = "month") -> DataFrame:
    """Forward fill, then back fill, within each group's months."""
    fwd = Window.partitionBy(key).orderBy(month).rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(key).orderBy(month).rowsBetween(0, Window.unboundedFollowing)
    out = series
    for c in cols:
        out = out.withColumn(f"{c}_filled", F.last(c, ignorenulls=True).over(fwd))
        out = out.withColumn(f"{c}_filled", F.coalesce(F.col(f"{c}_filled"), F.first(c, ignorenulls=True).over(bwd)))
    return out


def peak_month(series: DataFrame, key: str = "movie_name", month: str = "month", count: str = "count") -> DataFrame:
    """The month with most reviews (first on ties, zero months ignored); if every month
    is zero, the first month with count 0."""
    nz = F.col(count) > 0
    return series.groupBy(key).agg(
        F.coalesce(F.max_by(F.when(nz, F.col(month)), F.when(nz, F.struct(F.col(count), -F.unix_date(F.col(month))))),
                   F.min(month)).alias("peak_month"),
        F.coalesce(F.max(F.when(nz, F.col(count))), F.lit(0)).cast("long").alias("peak_count"))


def review_timeline(reviews: DataFrame, key: str = "movie_name", date: str = "date",
                    rating: str | None = "rating") -> dict[str, DataFrame]:
    """Monthly volume on a dense calendar with month labels, quarter ticks and peak;
    with ``rating``, also the monthly mean rating with gaps filled."""
    counts = monthly_count(reviews, key, date)
    if rating:
        counts = counts.join(monthly_mean(reviews, rating, key, date, "avg_rating"), [key, "month"], "left")
    dense = densify_months(counts, [key], "month", counts=["count"], means=["avg_rating"] if rating else [])
    dense = quarter_label(month_parts(dense), key)
    if rating:
        dense = fill_gaps(dense, ["avg_rating"], key)
    return {"series": dense, "peak": peak_month(dense, key)}


def linear_trend(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least-squares slope and intercept of y on x per group (null when x is constant)."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                               F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def trend_line(df: DataFrame, x: str, y: str, by: list[str], out: str = "trend") -> DataFrame:
    """Slope * x + intercept for every row, from A21 joined back on the group."""
    return (df.join(linear_trend(df, x, y, by), by, "left")
              .withColumn(out, F.col("slope") * F.col(x) + F.col("intercept")))


def key_points(df: DataFrame, col: str, by: list[str], date: str = "date", tie: str = "review_index") -> DataFrame:
    """First and last review by date, lowest and highest value; ties go to the earlier
    row in (date, tie) order."""
    first_key = F.struct(F.col(date), F.col(tie))
    valued = F.col(col).isNotNull()
    return df.groupBy(*by).agg(
        F.min_by(F.col(tie), first_key).alias("first_review"),
        F.max_by(F.col(tie), first_key).alias("last_review"),
        F.min_by(F.col(tie), F.when(valued, F.struct(F.col(col), F.col(date), F.col(tie)))).alias("lowest_review"),
        F.max_by(F.col(tie), F.when(valued, F.struct(F.col(col), -F.unix_micros(F.col(date).cast("timestamp")),
                                                     -F.col(tie)))).alias("highest_review"),
    )


def range_summary(df: DataFrame, col: str, by: list[str], date: str = "date") -> DataFrame:
    """First and last date, days with reviews, reviews, mean, min and max of ``col``."""
    return df.groupBy(*by).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.countDistinct(F.to_date(date)).alias("days_with_reviews"), F.count(F.lit(1)).alias("reviews"),
        F.avg(col).alias("mean"), F.min(col).alias("min"), F.max(col).alias("max"))


def sort_by_date(df: DataFrame, date: str = "date", tie: list[str] | None = None, rank: str | None = None) -> DataFrame:
    """O1: ascending by date, nulls last, then the tie-break columns; ``rank`` names a column for the place (then the
    tie-break columns must make the order total)."""
    if rank:
        last = F.lit((1 << 63) - 1)
        df = with_rank(df, [F.coalesce(F.unix_micros(F.col(date).cast("timestamp")), last), *[F.col(c) for c in tie or []]], rank)
    return df.orderBy(F.col(date).asc_nulls_last(), *(tie or []))


def rating_vs_text_by_day(reviews: DataFrame, rating: str, score: str, by: list[str],
                          date: str = "date", tie: str = "review_index") -> dict[str, DataFrame]:
    """Per group the days since the first review, trend lines of rating and text score,
    correlation with its interpretation, key points and the range summary."""
    from reelscope.functions.numbers import correlation_strength
    from reelscope.operators.disconnect import pearson_expr

    r = days_since_first(reviews.filter(F.col(date).isNotNull()), by, date, "days")
    x, y, z = F.col("days"), F.col(rating), F.col(score)
    # one aggregate: range summary, both trends and the correlation share one shuffle
    summary = r.groupBy(*by).agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.countDistinct(F.to_date(date)).alias("days_with_reviews"), F.count(F.lit(1)).alias("reviews"),
        F.avg(y).alias("mean"), F.min(y).alias("min"), F.max(y).alias("max"),
        F.regr_slope(y, x).alias("rating_slope"), F.regr_intercept(y, x).alias("rating_intercept"),
        F.regr_slope(z, x).alias("score_slope"), F.regr_intercept(z, x).alias("score_intercept"),
        pearson_expr(rating, score).alias("pearson_r"),
    ).withColumn("interpretation", correlation_strength(F.col("pearson_r")))
    return {"points": r, "summary": summary, "key_points": key_points(r, rating, by, date, tie)}


def deviation_series(reviews: DataFrame, sentences: DataFrame, rating: str, score: str,
                     key: str = "movie_name", date: str = "date") -> DataFrame:
    """Monthly mean rating and monthly mean text score side by side on the dense
    calendar, both gap-filled."""
    a = monthly_mean(reviews, rating, key, date, "avg_rating")
    b = monthly_mean(sentences, score, key, date, "avg_score")
    both = a.join(b, [key, "month"], "full")
    dense = densify_months(both, [key], "month", counts=[], means=["avg_rating", "avg_score"])
    return fill_gaps(dense, ["avg_rating", "avg_score"], key)
