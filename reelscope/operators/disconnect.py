"""Narrative-metric disconnect: sentence scores -> review score -> gap to the rating
(A1, A3, A4, A20-A24, J1-J3, J6 of the survey).

Every step is an aggregate or an equi-join on the review key. Aggregates use partial
(map-side) aggregation, so a review with a huge number of sentences does not put its
rows in one task; the joins are sort-merge joins on the review key, which AQE splits
when one key is skewed, or broadcasts when one side is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions.numbers import (
    disconnect, magnitude_range, review_score, round_half_even, signed_score, significance,
    SIGNIFICANCE_HIGH,
)

REVIEW_KEYS = ["movie_name", "review_index"]


def review_sentiment_score(sentences: DataFrame, keys: list[str] = REVIEW_KEYS,
                           label: str = "sentiment_label", score: str = "sentiment_score",
                           fold: bool = True) -> DataFrame:
    """A1 (with N10, N11): per review the sum of signed sentence scores, the number of
    sentences (non-null ``sentence_index``) and ``nmd_score = |50 + 50/n * sum|``."""
    return (sentences
            .groupBy(*keys)
            .agg(F.coalesce(F.sum(signed_score(label, score)), F.lit(0.0)).alias("sum_score"),
                 F.count("sentence_index").alias("num_sentences"))
            .withColumn("nmd_score", review_score(F.col("sum_score"), F.col("num_sentences"), fold)))


def attach_review_score(sentences: DataFrame, scores: DataFrame, keys: list[str] = REVIEW_KEYS) -> DataFrame:
    """LEFT join of the review score and sentence count back onto every sentence."""
    return sentences.join(scores.select(*keys, "nmd_score", "num_sentences"), keys, "left")


def attach_metadata(scored: DataFrame, meta: DataFrame, keys: list[str] = ["review_index"],
                    by_position: bool = False) -> DataFrame:
    """INNER join of scored sentences with the cleaning step's sentence table.

    ``meta`` has ``review_id, sentence_num`` (1-based, with gaps) and the review fields.
    The join is on the review; each field is its first non-null value in sentence order, so every scored sentence of a
    known review stays. ``by_position=True`` joins on (review, ``sentence_num - 1``) instead, as the reference does:
    sentences the two splitters number differently drop out.
    """
    m = meta.withColumnRenamed("review_id", "review_index")
    cols = ["username", "date", "rating", "source"]
    if by_position:
        m = m.select(*keys, (F.col("sentence_num") - 1).cast("long").alias("sentence_index"), *cols)
        return scored.join(m, [*keys, "sentence_index"], "inner")
    first = m.groupBy(*keys).agg(*[
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("sentence_num"))).alias(c) for c in cols])
    return scored.join(first, keys, "inner")


def review_summary(combined: DataFrame, keys: list[str] = REVIEW_KEYS) -> DataFrame:
    """A4: one row per review, the first non-null value of each field in sentence order
    (pandas ``first``), as ``review_date`` and ``user_rating``."""
    def first(c):
        return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("sentence_index")))
    return combined.groupBy(*keys).agg(
        first("username").alias("username"),
        first("date").alias("review_date"),
        first("rating").alias("user_rating"),
        first("source").alias("source"),
        first("nmd_score").alias("nmd_score"),
        first("num_sentences").alias("num_sentences"),
    )


def review_sentence_stats(sentences: DataFrame, keys: list[str] = REVIEW_KEYS,
                          label: str = "sentiment_label", score: str = "sentiment_score") -> DataFrame:
    """A3: per review the mean sentence score and the % of sentences labelled positive."""
    return sentences.groupBy(*keys).agg(
        F.avg(score).alias("avg_sentiment_score"),
        (F.avg((F.col(label) == "positive").cast("double")) * F.lit(100.0)).alias("positive_percentage"),
    )


REVIEW_SCORE_COLUMNS = ["review_index", "username", "review_date", "user_rating", "source", "num_sentences",
                        "sum_score", "nmd_score", "avg_sentiment_score", "positive_percentage"]


def merge_review_metrics(summary: DataFrame, scores: DataFrame, stats: DataFrame,
                         keys: list[str] = REVIEW_KEYS) -> DataFrame:
    """J3 + P1: LEFT joins of ``sum_score`` and of the A3 stats onto the review summary,
    in the reference's column order (the movie key in front)."""
    out = (summary.join(scores.select(*keys, "sum_score"), keys, "left")
                  .join(stats, keys, "left"))
    extra = [k for k in keys if k not in REVIEW_SCORE_COLUMNS]
    return out.select(*extra, *REVIEW_SCORE_COLUMNS)


def final_scores(review_scores: DataFrame, keep_missing: bool = True) -> DataFrame:
    """N12 + N13 on the review table: ``mss``, ``nmd_difference``, ``significance_category``."""
    return (review_scores.withColumnRenamed("nmd_score", "mss")
            .withColumn("nmd_difference", disconnect("mss", "user_rating"))
            .withColumn("significance_category", significance("nmd_difference", keep_missing)))


def pearson_expr(x: str, y: str):
    """A20 as an aggregate expression: Pearson r over rows where both values exist; null for
    fewer than two rows or no variance. ``corr`` would throw on a constant column under
    ANSI, so the ratio goes through ``try_divide``."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None, out: str = "pearson_r") -> DataFrame:
    """Correlation overall or per group."""
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(pearson_expr(x, y).alias(out), F.count(F.lit(1)).alias("n_rows"))


def category_share(df: DataFrame, col: str, by: list[str] | None = None, out: str = "percentage") -> DataFrame:
    """% of rows per category (within ``by`` groups). The per-group total is a window
    over the already aggregated (group, category) rows, which are few."""
    from pyspark.sql import Window as W
    by = by or []
    counts = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return counts.withColumn(out, F.col("n") / F.sum("n").over(w) * F.lit(100.0))


def significance_table(final: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A23 (+ J6, N14): per band its magnitude range, share % and Pearson r of rating vs
    text score, both rounded to 2 digits. One aggregate computes share and r together."""
    from pyspark.sql import Window as W
    by = by or []
    cat = "significance_category"
    agg = final.groupBy(*by, cat).agg(F.count(F.lit(1)).alias("n"),
                                      pearson_expr("user_rating", "mss").alias("r"))
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return agg.select(
        *by, cat,
        magnitude_range(F.col(cat)).alias("nmd_magnitude_range"),
        round_half_even(F.col("n") / F.sum("n").over(w) * F.lit(100.0), 2).alias("percentage"),
        round_half_even(F.col("r"), 2).alias("pearson_r"),
        F.col("n").alias("n_reviews"),
    )


def relationship_collapse(table: DataFrame, by: list[str] | None = None, threshold: float = 0.2) -> DataFrame:
    """True when r of the High band is below ``threshold``. A group without a High
    band counts as r = 0 (true); a High band with a null r is false (NaN < x is false)."""
    by = by or []
    high = F.col("significance_category") == SIGNIFICANCE_HIGH
    g = table.groupBy(*by) if by else table.groupBy()
    return g.agg(
        F.max(high.cast("int")).alias("_has_high"),
        F.max(F.when(high, F.col("pearson_r"))).alias("high_r"),
    ).select(*by, "high_r",
             F.when(F.col("_has_high") == 0, F.lit(True))
              .otherwise(F.coalesce(F.col("high_r") < threshold, F.lit(False))).alias("collapse"))


def narrative_metric_disconnect(sentences: DataFrame, meta: DataFrame, keys: list[str] = REVIEW_KEYS,
                                by_position: bool = False) -> dict[str, DataFrame]:
    """The whole disconnect flow. Returns the review table, the final table with
    bands, the per-movie significance table and the collapse flag."""
    movie = [k for k in keys if k != "review_index"]
    scores = review_sentiment_score(sentences, keys)
    with_score = attach_review_score(sentences, scores, keys)
    combined = attach_metadata(with_score, meta, ["review_index"], by_position)
    summary = review_summary(combined, keys)
    stats = review_sentence_stats(sentences, keys)
    review_scores = merge_review_metrics(summary, scores, stats, keys)
    final = final_scores(review_scores)
    table = significance_table(final, movie)
    return {"review_scores": review_scores, "final": final, "table": table,
            "collapse": relationship_collapse(table, movie)}
