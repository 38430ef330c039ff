"""Checked queries for the data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions.dates import parse_review_date
from reelscope.operators import profile as P
from reelscope.plans import sqlfrag as Q
from reelscope.plans import views as V
from reelscope.plans.catalog import oracle, register

REV = [V.SQL_V_REV]
COLS = [("review_id", "bigint"), ("movie_name", "string"), ("username", "string"), ("date", "timestamp_ntz"),
        ("review_text", "string"), ("rating", "double"), ("source", "string")]


def _a12_sql() -> str:
    parts = []
    for c, t in COLS:
        sample = f"CAST(arg_min({c}, review_id) FILTER (WHERE {c} IS NOT NULL) AS VARCHAR)"
        prev = f"CASE WHEN length({sample}) > 30 THEN substr({sample}, 1, 27) || '...' ELSE {sample} END"
        parts.append(f"SELECT count(*) AS total_rows, '{c}' AS column_name, '{t}' AS data_type, "
                     f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count, "
                     f"{prev} AS sample, count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) AS null_percentage "
                     f"FROM v_rev")
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c, _ in COLS)
    parts.append(f"SELECT count(*), '*', NULL, CAST({nulls} AS BIGINT), NULL, NULL, "
                 f"({nulls}) * 100.0 / (count(*) * {len(COLS)}) FROM v_rev")
    return oracle(" UNION ALL ".join(parts), REV, doubles=("null_percentage",))


@register("A12_column_profile", _a12_sql())
def a12(spark, sf):
    """Per-column profile of the review table in one aggregation job."""
    return P.column_profile(V.v_rev(spark, sf).select(*[c for c, _ in COLS]), "review_id")


A13_SQL = """SELECT movie_name, count(*) AS total_reviews, count(*) FILTER (WHERE source = 'imdb') AS imdb,
  count(*) FILTER (WHERE source = 'ltbx') AS ltbx, count(*) FILTER (WHERE source = 'rt') AS rt,
  count(*) FILTER (WHERE review_text IS NULL) AS review_text_nulls, count(*) FILTER (WHERE rating IS NULL) AS rating_nulls
  FROM v_rev GROUP BY movie_name"""


@register("A13_movie_source_table", oracle(A13_SQL, REV))
def a13(spark, sf):
    """Per movie the totals by site and the null counts."""
    return P.movie_source_table(V.v_rev(spark, sf))


@register("N17_high_null_flag", oracle(
    f"""SELECT *, review_text_nulls * 100.0 / total_reviews AS review_text_null_pct,
               rating_nulls * 100.0 / total_reviews AS rating_null_pct,
               review_text_nulls * 100.0 / total_reviews > 5.0 OR rating_nulls * 100.0 / total_reviews > 5.0 AS high_nulls
        FROM ({A13_SQL})""", REV, doubles=("review_text_null_pct", "rating_null_pct")))
def n17(spark, sf):
    """Movies whose text-null or rating-null share is above the threshold (5 % here)."""
    return P.high_null_flag(P.movie_source_table(V.v_rev(spark, sf)), 5.0)


@register("A14_grand_totals", oracle(
    f"""SELECT count(*) AS movies, """ + ", ".join(
        f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("total_reviews", "imdb", "ltbx", "rt", "review_text_nulls", "rating_nulls"))
    + ", " + ", ".join(f"sum({c}) * 100.0 / sum(total_reviews) AS {c}_pct"
                       for c in ("imdb", "ltbx", "rt", "review_text_nulls", "rating_nulls"))
    + f" FROM ({A13_SQL})", REV,
    doubles=tuple(f"{c}_pct" for c in ("imdb", "ltbx", "rt", "review_text_nulls", "rating_nulls"))))
def a14(spark, sf):
    """Totals over movies with shares and the number of movies."""
    return P.grand_totals(P.movie_source_table(V.v_rev(spark, sf)))


@register("A15_combined_profile", oracle(
    """SELECT movie_name, count(*) AS reviews, avg(rating) AS rating_mean, min(rating) AS rating_min,
              max(rating) AS rating_max, stddev_samp(rating) AS rating_std,
              count(*) FILTER (WHERE source = 'imdb') / count(*) * 100.0 AS imdb_share,
              count(*) FILTER (WHERE source = 'ltbx') / count(*) * 100.0 AS ltbx_share,
              count(*) FILTER (WHERE source = 'rt') / count(*) * 100.0 AS rt_share
       FROM v_rev GROUP BY movie_name""", REV,
    doubles=("rating_mean", "rating_min", "rating_max", "rating_std", "imdb_share", "ltbx_share", "rt_share")))
def a15(spark, sf):
    """Rating statistics (sample std) and source shares per movie."""
    return P.combined_profile(V.v_rev(spark, sf))


@register("A16_date_quality", oracle(
    f"""SELECT source, count(*) AS rows, count(*) FILTER (WHERE {Q.missing('raw_date')}) AS nulls_before,
               count(*) FILTER (WHERE {Q.missing('raw_date')}) / count(*) * 100.0 AS null_pct_before,
               count(*) FILTER (WHERE p IS NULL) AS nulls_after, count(*) FILTER (WHERE p IS NULL) / count(*) * 100.0 AS null_pct_after,
               count(*) FILTER (WHERE p IS NULL) - count(*) FILTER (WHERE {Q.missing('raw_date')}) AS unparsed
        FROM (SELECT *, {Q.parse_review_date('raw_date', 2025)} AS p FROM v_rev) GROUP BY source""", REV,
    doubles=("null_pct_before", "null_pct_after")))
def a16(spark, sf):
    """Null dates before and after parsing, per site, in one pass."""
    r = V.v_rev(spark, sf).withColumn("parsed", parse_review_date("raw_date", 2025))
    return P.date_quality(r, "raw_date", "parsed", ["source"])


del F
