"""Checked queries for projections, filters, unions, de-duplication and the cleaning flow
(P1-P10, U1-U8, J5, Z1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions.dates import parse_review_date
from reelscope.operators import cleaning as C
from reelscope.operators import reshape as R
from reelscope.plans import sqlfrag as Q
from reelscope.plans import views as V
from reelscope.plans.catalog import oracle, register

YEAR = 2025
REV = [V.SQL_V_REV]
DOC = [V.SQL_V_DOC]
REV_COLS = ["review_id", "movie_name", "username", "date", "review_text", "rating", "source"]


# ------------------------------------------------------------------ raw site tables from orders

def raw_sites(spark, sf):
    """The three sites' raw tables, shaped like their CSVs, from the review view. The
    Letterboxd table is pulled twice (earliest and latest batch), so every review appears
    in both pulls, as in the reference's data."""
    r = V.v_rev(spark, sf)
    k = F.col("review_id")
    order = lambda b: F.struct(F.lit(b).alias("batch"), k.alias("row"))
    imdb = r.filter(F.col("source") == "imdb").select(
        "movie_name", F.col("username").alias("Username"), F.col("raw_date").alias("Date"),
        F.when(k % 3 == 0, F.concat(F.lit("Title "), F.col("username"))).alias("Title"),
        F.col("review_text").alias("Review Text"), F.col("raw_rating").alias("Rating"), order(0).alias("_order"))
    ltbx = r.filter(F.col("source") == "ltbx").select(
        "movie_name", "username", F.col("raw_rating").alias("rating"), "review_text",
        F.col("raw_date").alias("date"),
        F.when(k % 2 == 0, F.lit("watch")).otherwise(F.lit("rewatch")).alias("viewing_type"),
        order(0).alias("_o0"), order(1).alias("_o1"))
    rt = r.filter(F.col("source") == "rt").select(
        "movie_name", F.col("username").alias("Name"), F.col("review_text").alias("Review Content"),
        F.col("raw_date").alias("Date"), F.col("raw_rating").alias("Rating"),
        F.when(k % 2 == 0, F.lit("Audience")).otherwise(F.lit("Critic")).alias("Type"), order(0).alias("_order"))
    earliest = ltbx.withColumnRenamed("_o0", "_order").drop("_o1")
    latest = ltbx.withColumnRenamed("_o1", "_order").drop("_o0")
    return imdb, earliest, latest, rt


SQL_SITES = f"""
imdb AS (
  SELECT movie_name, username AS Username, {Q.parse_review_date('raw_date', YEAR)} AS Date,
         CASE WHEN review_id % 3 = 0 THEN 'Title ' || username END AS Title,
         review_text AS "Review Text", raw_rating AS Rating, 0 AS batch, review_id AS row
  FROM v_rev WHERE source = 'imdb'),
ltbx AS (
  SELECT movie_name, username, raw_rating AS rating, review_text, {Q.parse_review_date('raw_date', YEAR)} AS date,
         CASE WHEN review_id % 2 = 0 THEN 'watch' ELSE 'rewatch' END AS viewing_type, b AS batch, review_id AS row
  FROM v_rev, (SELECT 0 AS b UNION ALL SELECT 1) batches WHERE source = 'ltbx'),
rt AS (
  SELECT movie_name, username AS Name, review_text AS "Review Content", {Q.parse_review_date('raw_date', YEAR)} AS Date,
         raw_rating AS Rating, 0 AS batch, review_id AS row
  FROM v_rev WHERE source = 'rt'),
imdb_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_name, Username, "Review Text", Date
                                                       ORDER BY batch, row) AS rn FROM imdb) WHERE rn = 1),
ltbx_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_name, username, review_text, date, viewing_type
                                                       ORDER BY batch, row) AS rn FROM ltbx) WHERE rn = 1),
rt_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movie_name, Name, "Review Content", Date
                                                     ORDER BY batch, row) AS rn FROM rt) WHERE rn = 1)
"""


def _sql_title_text():
    has_t = "(Title IS NOT NULL AND Title <> '')"
    has_x = "(\"Review Text\" IS NOT NULL AND \"Review Text\" <> '')"
    return (f"CASE WHEN {has_t} AND {has_x} THEN Title || ': ' || \"Review Text\" WHEN {has_x} THEN \"Review Text\" "
            f"ELSE '' END")


def _emoji(e):
    return f"regexp_replace({e}, '{Q.EMOJI}', '', 'g')"


def _clip(e):
    x = Q.to_double(e)
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(100.0, {x})) END)"


def _z1_sql():
    from reelscope.plans.cases_functions import _sql_imdb, _sql_ltbx, _sql_rt
    body = f"""
SELECT movie_name, username, date, review_text, {_clip('rating')} AS rating, source,
       CAST(site AS BIGINT) AS order_site, CAST(batch AS BIGINT) AS order_batch, row AS order_row FROM (
  SELECT movie_name, Username AS username, Date AS date, {_emoji(_sql_title_text())} AS review_text,
         {_sql_imdb('Rating')} AS rating, 'imdb' AS source, 0 AS site, batch, row FROM imdb_d
  UNION ALL
  SELECT movie_name, username, date, {_emoji('review_text')}, {_sql_ltbx('rating')}, 'ltbx', 1, batch, row FROM ltbx_d
  UNION ALL
  SELECT movie_name, Name, Date, {_emoji('"Review Content"')}, {_sql_rt('Rating')}, 'rt', 2, batch, row FROM rt_d)"""
    return body


def _flatten_order(df):
    return df.select(*C.CANONICAL, F.col("_order.site").cast("long").alias("order_site"),
                     F.col("_order.within.batch").cast("long").alias("order_batch"),
                     F.col("_order.within.row").alias("order_row"))


@register("Z1_clean_reviews")
def z1(spark, sf):
    """Z1 (D1, D3, U1, U6, U2, T1, T2, N1-N4): raw site tables -> canonical reviews."""
    imdb, le, ll, rt = raw_sites(spark, sf)
    return _flatten_order(C.clean_reviews(imdb, le, ll, rt, YEAR))


@register("U2_unify_sources")
def u2(spark, sf):
    """The three site schemas onto the canonical review (both Letterboxd pulls, no de-duplication)."""
    imdb, le, ll, rt = raw_sites(spark, sf)
    parse = lambda d, c: d.withColumn(c, parse_review_date(c, YEAR))
    return _flatten_order(C.unify_sources(parse(imdb, "Date"), parse(R.union_batches(le, ll), "date"), parse(rt, "Date")))


@register("U1_union_batches")
def u1(spark, sf):
    """The two Letterboxd pulls, earliest first, with the order key."""
    _, le, ll, _ = raw_sites(spark, sf)
    u = R.union_batches(le, ll)
    return u.select("movie_name", "username", "review_text", "viewing_type",
                    F.col("_order.batch").cast("long").alias("batch"), F.col("_order.row").alias("row"))


@register("U5_check_union_rows", oracle(
    "SELECT parts, parts_rows, union_rows, parts_rows = union_rows AS equal FROM ("
    "SELECT 'all' AS parts, count(*) AS parts_rows, count(*) AS union_rows FROM v_rev UNION ALL "
    "SELECT 'without rt', count(*) FILTER (WHERE source IS DISTINCT FROM 'rt'), count(*) FROM v_rev)",
    REV))
def u5(spark, sf):
    """The sites' parts against the review table, once complete and once with a part that was lost."""
    r = V.v_rev(spark, sf)
    parts = [r.filter(F.col("source").eqNullSafe(F.lit(s))) for s in (None, "imdb", "ltbx", "rt")]
    named = [("all", parts), ("without rt", parts[:-1])]
    return R.union_all([R.check_union_rows(p, r).select(F.lit(n).alias("parts"), "parts_rows", "union_rows", "equal")
                        for n, p in named])


@register("U6_dedup_keep_first", oracle(
    "SELECT " + ", ".join(REV_COLS) + " FROM (SELECT *, row_number() OVER (PARTITION BY movie_name, username "
    "ORDER BY review_id) AS rn FROM v_rev) WHERE rn = 1", REV, doubles=("rating",), stamps=("date",)))
def u6(spark, sf):
    """First review (by id) of each (movie, user)."""
    r = V.v_rev(spark, sf).select(*REV_COLS)
    return R.dedup_keep_first(r, ["movie_name", "username"], "review_id")


@register("U7_review_fingerprint", oracle(
    "SELECT " + ", ".join(REV_COLS) + " FROM (SELECT *, row_number() OVER (PARTITION BY source, username, date, "
    "review_text ORDER BY review_id) AS rn FROM v_rev) WHERE rn = 1",
    REV, doubles=("rating",), stamps=("date",)))
def u7(spark, sf):
    """First row of each (source, name, date, whole text)."""
    r = V.v_rev(spark, sf).select(*REV_COLS)
    return R.unique_reviews(r, "source", "username", "date", "review_text", "review_id")


@register("U8_cap_per_group", oracle(
    "SELECT " + ", ".join(REV_COLS) + " FROM (SELECT *, row_number() OVER (PARTITION BY movie_name, source "
    "ORDER BY review_id) AS rn FROM v_rev) WHERE rn <= 80", REV, doubles=("rating",), stamps=("date",)))
def u8(spark, sf):
    """U8: at most 80 reviews per (movie, site), first by id."""
    r = V.v_rev(spark, sf).select(*REV_COLS)
    return R.cap_per_group(r, ["movie_name", "source"], 80, ["review_id"])


@register("P1_project", oracle(
    "SELECT review_id, username, date AS review_date, rating AS user_rating, source FROM v_rev",
    REV, doubles=("user_rating",), stamps=("review_date",)))
def p1(spark, sf):
    """Rename and reorder."""
    return R.project(V.v_rev(spark, sf), {"date": "review_date", "rating": "user_rating"},
                     ["review_id", "username", "review_date", "user_rating", "source"])


@register("P2_drop_empty_text", oracle(
    "SELECT review_id, review_text FROM v_rev WHERE " + Q.strip("coalesce(review_text, '')") + " <> ''", REV))
def p2(spark, sf):
    """Drop null or blank texts."""
    return R.drop_empty_text(V.v_rev(spark, sf).select("review_id", "review_text"), "review_text")


@register("P3_filter_movie", oracle(
    "SELECT " + ", ".join(REV_COLS) + " FROM v_rev WHERE movie_name = '3-MEDIUM'",
    REV, doubles=("rating",), stamps=("date",)))
def p3(spark, sf):
    """One movie."""
    return R.filter_movie(V.v_rev(spark, sf).select(*REV_COLS), "3-MEDIUM")


@register("P4_drop_null", oracle(
    "SELECT " + ", ".join(REV_COLS) + " FROM v_rev WHERE date IS NOT NULL",
    REV, doubles=("rating",), stamps=("date",)))
def p4(spark, sf):
    """Drop rows without a date."""
    return R.drop_null(V.v_rev(spark, sf).select(*REV_COLS), ["date"])


@register("P5_null_rows", oracle(
    "SELECT review_id, movie_name, username, rating FROM v_rev WHERE date IS NULL", REV, doubles=("rating",)))
def p5(spark, sf):
    """P5: the rows with a null date (all of them; ``n`` limits it for display)."""
    return R.null_rows(V.v_rev(spark, sf), "date", ["review_id", "movie_name", "username", "rating"], ["review_id"])


@register("P6_P7_text_column", oracle("SELECT doc_id, text AS review_text FROM v_doc", DOC))
def p6(spark, sf):
    """P6 + P7: the text column picked from the candidates, after the input contract."""
    d = R.require_columns(V.v_doc(spark, sf), ["doc_id"])
    c = R.first_present_column(d, R.TEXT_CANDIDATES)
    return d.select("doc_id", F.col(c).alias("review_text"))


@register("P8_add_movie_tag_source", oracle(
    "SELECT 'documents' AS movie_name, doc_id, lang, 'web' AS source FROM v_doc", DOC))
def p8(spark, sf):
    """Literal movie and source columns."""
    d = V.v_doc(spark, sf).select("doc_id", "lang")
    return R.tag_source(R.add_movie(d, "documents"), "web")


@register("P9_min_docs_gate", oracle(
    "SELECT doc_id, lang, source FROM v_doc WHERE (lang, source) IN "
    "(SELECT (lang, source) FROM v_doc GROUP BY lang, source HAVING count(*) >= 10)", DOC))
def p9(spark, sf):
    """Groups (language, source) with fewer than 10 texts are left out."""
    return R.min_docs_gate(V.v_doc(spark, sf).select("doc_id", "lang", "source"), ["lang", "source"], 10)


@register("P10_head", oracle(
    "SELECT review_id, movie_name, rating FROM v_rev ORDER BY rating DESC NULLS LAST, review_id LIMIT 10",
    REV, doubles=("rating",)))
def p10(spark, sf):
    """P10: the ten highest-rated reviews (a top-n report)."""
    r = V.v_rev(spark, sf).select("review_id", "movie_name", "rating")
    return R.head(r, 10, [F.col("rating").desc_nulls_last(), F.col("review_id")])


@register("J5_lookup", oracle(
    "SELECT event_id, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 1.0 WHEN 'error' THEN -2.0 "
    "ELSE 0.0 END AS weight FROM events", [], doubles=("weight",)))
def j5(spark, sf):
    """Dictionary lookup with a default."""
    e = V.table(spark, sf, "events")
    return e.select("event_id", R.lookup("event_type", {"purchase": 1.0, "signup": 1.0, "error": -2.0}, 0.0)
                    .alias("weight"))


# ---- oracles that need the site CTEs
from reelscope.plans.catalog import REGISTRY  # noqa: E402


def _sites_sql(select: str, doubles=(), stamps=()) -> str:
    inner = oracle("SELECT * FROM z1_out", [], doubles=doubles, stamps=stamps)
    return "WITH " + V.SQL_V_REV + "," + SQL_SITES + f", z1_out AS ({select})\n" + inner


REGISTRY["Z1_clean_reviews"].sql = _sites_sql(_z1_sql(), doubles=("rating",), stamps=("date",))
REGISTRY["U2_unify_sources"].sql = _sites_sql(
    _z1_sql().replace("FROM imdb_d", "FROM imdb").replace("FROM ltbx_d", "FROM ltbx")
    .replace("FROM rt_d", "FROM rt"), doubles=("rating",), stamps=("date",))
REGISTRY["U1_union_batches"].sql = _sites_sql(
    "SELECT movie_name, username, review_text, viewing_type, CAST(batch AS BIGINT) AS batch, row FROM ltbx")
