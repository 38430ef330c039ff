"""Sentiment summaries per movie (A5-A11, A27, A34, A35 and the Z3 flow).

Every summary is one ``groupBy(movie)`` with conditional aggregates (``count_if``,
``avg(when ...)``), i.e. one partial aggregation over the sentences; per-label numbers do
not need a pivot or a second pass. Rounding follows Python ``round`` (half-even on the
binary value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.operators.ordering import with_rank
from reelscope.functions.numbers import pct, round_half_even, score_bin, standardize_label, to_double

LABELS = ["positive", "neutral", "negative"]


def with_standard_label(df: DataFrame, label: str = "sentiment", out: str = "sentiment_std") -> DataFrame:
    """N5 on the label column."""
    return df.withColumn(out, standardize_label(F.col(label)))


def label_distribution_aggs(label: str = "sentiment_std", digits: int = 2) -> list[Column]:
    """Count and % per label (0 when absent); % of all rows, 0 when there are none."""
    n = F.count(F.lit(1))
    out = []
    for lab in LABELS:
        c = F.count_if(F.col(label) == lab)
        out += [c.alias(f"{lab}_count"), pct(c, n, digits).alias(f"{lab}_percentage")]
    return out


def confidence_aggs(conf: str = "confidence", label: str = "sentiment_std") -> list[Column]:
    """Mean, min, max confidence to 3 digits; mean per label (null when the label is absent)."""
    c = F.col(conf)
    out = [round_half_even(F.avg(c), 3).alias("avg_confidence"),
           round_half_even(F.min(c), 3).alias("min_confidence"),
           round_half_even(F.max(c), 3).alias("max_confidence")]
    out += [round_half_even(F.avg(F.when(F.col(label) == lab, c)), 3).alias(f"avg_confidence_{lab}") for lab in LABELS]
    return out


def rating_aggs(rating: str = "rating", label: str = "sentiment_std") -> list[Column]:
    """Numeric ratings only: mean (2 digits), min, max; mean per label."""
    r = to_double(F.col(rating))
    out = [round_half_even(F.avg(r), 2).alias("avg_rating"), F.min(r).alias("min_rating"), F.max(r).alias("max_rating")]
    out += [round_half_even(F.avg(F.when(F.col(label) == lab, r)), 2).alias(f"avg_rating_{lab}") for lab in LABELS]
    return out


def rating_aggs_basic(rating: str = "rating") -> list[Column]:
    """The review-level variant: mean to 1 digit, min and max cut to whole numbers."""
    r = to_double(F.col(rating))
    return [round_half_even(F.avg(r), 1).alias("avg_rating"), F.min(r).cast("long").alias("min_rating"),
            F.max(r).cast("long").alias("max_rating")]


def source_counts(df: DataFrame, by: list[str], source: str = "source") -> DataFrame:
    """A10 (rows form): count and share of each source within the group."""
    from pyspark.sql import Window as W
    counts = df.groupBy(*by, source).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)) * F.lit(100.0))


def source_map(df: DataFrame, by: list[str], source: str = "source") -> DataFrame:
    """A10 (map form): ``sources`` as source -> count. The per-group list has one entry
    per distinct source, so it stays small."""
    counts = df.filter(F.col(source).isNotNull()).groupBy(*by, source).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(source), F.col("n")))).alias("sources"))


def movie_summary(scored: DataFrame, analysis_date: str, movie: str = "movie_name", label: str = "sentiment",
                  conf: str = "confidence", rating: str = "rating", source: str = "source") -> DataFrame:
    """One record per movie: rows, run stamp, A6 + A7 + A8 + A10 (sources as a map).
    The run stamp is a parameter, never the clock."""
    s = with_standard_label(scored, label)
    main = s.groupBy(movie).agg(F.count(F.lit(1)).alias("total_rows"), *label_distribution_aggs(),
                                *confidence_aggs(conf), *rating_aggs(rating))
    out = main.join(source_map(s, [movie], source), movie, "left")
    return out.select(F.col(movie).alias("movie"), "total_rows", F.lit(analysis_date).alias("analysis_date"),
                      *[c for c in out.columns if c not in (movie, "total_rows")])


def master_summary(summaries: DataFrame, analysis_date: str) -> DataFrame:
    """One row per movie (missing numbers 0), largest first, then an ``All Movies`` row
    with the total rows and *unweighted* means of the percentages, confidence and rating."""
    cols = ["total_rows"] + [f"{lab}_{k}" for lab in LABELS for k in ("count", "percentage")]
    rows = summaries.select("movie", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols],
                            F.coalesce(F.col("avg_confidence"), F.lit(0.0)).alias("avg_confidence"),
                            F.coalesce(F.col("avg_rating"), F.lit(0.0)).alias("avg_rating"),
                            F.lit(analysis_date).alias("analysis_date"))
    every = F.col("_all")
    means = {**{f"{lab}_percentage": 2 for lab in LABELS}, "avg_confidence": 3, "avg_rating": 2}
    # a movie's row and its part of the total come from one reading; the total is summed in the tasks first
    both = rows.withColumn("_all", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("movie", F.when(~every, F.col("movie")))
    out = both.groupBy("_all", "movie", "analysis_date").agg(
        *[F.sum(c).alias(c) for c in cols if c not in means],
        *[F.when(every, round_half_even(F.avg(c), d)).otherwise(F.max(c)).alias(c) for c, d in means.items()])
    return out.withColumn("movie", F.when(every, F.lit("All Movies")).otherwise(F.col("movie"))).select(*rows.columns)


def sort_summary(summary: DataFrame, rank: str | None = None) -> DataFrame:
    """O2: movies by rows, largest first (the ``All Movies`` row last); ``rank`` names a column for the place."""
    if rank:
        last = F.lit((1 << 63) - 1)
        rows = F.when(F.col("movie") == "All Movies", last).otherwise(-F.col("total_rows"))
        summary = with_rank(summary, [rows, F.col("movie")], rank)
    return summary.orderBy((F.col("movie") == "All Movies").asc(), F.col("total_rows").desc(), F.col("movie"))


def unique_reviews(df: DataFrame, keys: list[str], rating: str, score: str, order: str) -> DataFrame:
    """A5: per (review, user, day): first rating in sentence order and mean score (to nine digits, so that the order
    of the sum does not show). Rows with a null key are dropped first, as pandas ``groupby`` does."""
    return (df.dropna(subset=keys).groupBy(*keys)
              .agg(F.min_by(F.col(rating), F.when(F.col(rating).isNotNull(), F.col(order))).alias("rating"),
                   F.round(F.avg(score), 9).alias("mean_score"), F.count(F.lit(1)).alias("n_rows")))


def score_histogram(sentences: DataFrame, score: str = "sentiment_score", label: str = "sentiment_label",
                    by: list[str] | None = None, bins: int = 30) -> DataFrame:
    """A34 (+ N20): count per (score bin, label) with the label's total."""
    from pyspark.sql import Window as W
    by = by or []
    h = sentences.groupBy(*by, score_bin(F.col(score), bins=bins).alias("score_bin"), label).agg(
        F.count(F.lit(1)).alias("n"))
    return h.withColumn("label_total", F.sum("n").over(W.partitionBy(*by, label)))


def table_glance(df: DataFrame, rating: str = "rating", source: str = "source", n_sources: int = 5) -> DataFrame:
    """A35 in long form (item, number, text): rows, rating range, column names and up to
    ``n_sources`` distinct sources in order. One aggregate plus a bounded top-n; no join."""
    stats = df.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.min(rating).cast("double").alias("min_rating"),
                   F.max(rating).cast("double").alias("max_rating"))
    items = stats.select(F.explode(F.array(
        *[F.struct(F.lit(k).alias("item"), F.col(k).alias("number"), F.lit(None).cast("string").alias("text"))
          for k in ("rows", "min_rating", "max_rating")])).alias("r")).select("r.*")
    cols = df.sparkSession.range(1).select(F.lit("columns").alias("item"), F.lit(None).cast("double").alias("number"),
                                          F.lit(", ".join(df.columns)).alias("text"))
    srcs = (df.select(F.col(source).alias("text")).where(F.col("text").isNotNull()).distinct()
              .orderBy("text").limit(n_sources)
              .select(F.lit("source").alias("item"), F.lit(None).cast("double").alias("number"), "text"))
    return items.unionByName(cols).unionByName(srcs)
