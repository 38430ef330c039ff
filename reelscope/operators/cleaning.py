"""Raw site tables -> canonical reviews (U2 and the Z1 flow of the survey).

Steps, as in the reference: dates parsed in place (D1), keep-first de-duplication per
site on the site's keys (U6), then the three schemas mapped onto one review table
(title + text for IMDb, emoji removal, ratings on a 0-100 scale), date cast and rating
clip (D4, N4). Any site may be missing. Everything is projections, one union and one
partial aggregate per site; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions.dates import parse_review_date
from reelscope.functions.numbers import clip_0_100, rating_pct_imdb, rating_pct_ltbx, rating_pct_rt
from reelscope.functions.text import strip_emojis, title_plus_text
from reelscope.operators.reshape import dedup_keep_first, union_all, union_batches

# The de-duplication keys of each site (raw column names).
IMDB_KEYS = ["Username", "Review Text", "Date"]
LTBX_KEYS = ["username", "review_text", "date", "viewing_type"]
RT_KEYS = ["Name", "Review Content", "Date"]

CANONICAL = ["movie_name", "username", "date", "review_text", "rating", "source"]
ORDER = "_order"


def parse_site_dates(df: DataFrame, col: str, as_of_year: int) -> DataFrame:
    """D1 in place on one site table."""
    return df.withColumn(col, parse_review_date(col, as_of_year))


def canonical_imdb(df: DataFrame) -> DataFrame:
    text = strip_emojis(title_plus_text("Title", "Review Text"))
    return df.select("movie_name", F.col("Username").alias("username"), F.col("Date").alias("date"),
                     text.alias("review_text"), rating_pct_imdb("Rating").alias("rating"),
                     F.lit("imdb").alias("source"), ORDER)


def canonical_ltbx(df: DataFrame) -> DataFrame:
    return df.select("movie_name", "username", "date", strip_emojis("review_text").alias("review_text"),
                     rating_pct_ltbx("rating").alias("rating"), F.lit("ltbx").alias("source"), ORDER)


def canonical_rt(df: DataFrame) -> DataFrame:
    return df.select("movie_name", F.col("Name").alias("username"), F.col("Date").alias("date"),
                     strip_emojis("Review Content").alias("review_text"), rating_pct_rt("Rating").alias("rating"),
                     F.lit("rt").alias("source"), ORDER)


def unify_sources(imdb: DataFrame | None, ltbx: DataFrame | None, rt: DataFrame | None) -> DataFrame:
    """The three site schemas as one canonical review table, in the order imdb, ltbx,
    rt (the order key carries the site rank in front)."""
    parts = []
    for rank, (df, fn) in enumerate([(imdb, canonical_imdb), (ltbx, canonical_ltbx), (rt, canonical_rt)]):
        if df is not None:
            part = fn(df)
            parts.append(part.withColumn(ORDER, F.struct(F.lit(rank).alias("site"), F.col(ORDER).alias("within"))))
    out = union_all(parts)
    return (out.withColumn("date", F.col("date").cast("timestamp_ntz"))
               .withColumn("rating", clip_0_100("rating")))


def clean_reviews(imdb: DataFrame | None, ltbx_earliest: DataFrame | None, ltbx_latest: DataFrame | None,
                  rt: DataFrame | None, as_of_year: int) -> DataFrame:
    """Raw site tables (each with ``movie_name`` and an ``_order`` key, see
    ``reshape.with_order_key``) -> canonical reviews with the order key kept."""
    ltbx = None
    if ltbx_earliest is not None and ltbx_latest is not None:
        ltbx = union_batches(ltbx_earliest, ltbx_latest, ORDER)
    else:
        ltbx = ltbx_earliest if ltbx_earliest is not None else ltbx_latest
    if imdb is not None:
        imdb = dedup_keep_first(parse_site_dates(imdb, "Date", as_of_year), ["movie_name", *IMDB_KEYS], ORDER)
    if ltbx is not None:
        ltbx = dedup_keep_first(parse_site_dates(ltbx, "date", as_of_year), ["movie_name", *LTBX_KEYS], ORDER)
    if rt is not None:
        rt = dedup_keep_first(parse_site_dates(rt, "Date", as_of_year), ["movie_name", *RT_KEYS], ORDER)
    return unify_sources(imdb, ltbx, rt)
