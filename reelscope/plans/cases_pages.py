"""Checked queries for review extraction from saved pages (X1-X6, A33) on ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.operators import pages as X
from reelscope.plans import sqlfrag as Q
from reelscope.plans import views as V
from reelscope.plans.catalog import oracle, register

PAGE = [V.SQL_V_PAGE]

# Item patterns, in order: the first with any hit on a page decides.
ITEMS = ['(?s)<div class="review-row">(.*?)</div>', "(?s)<p>(.*?)</p>"]

# Field rules for one item: ordered patterns (group 1) and the default.
ITEM_RULES = {
    "Review Content": (['<span class="review-text">([^<]*)</span>', "<br><p>([^<]+)", "^([^<]+)"],
                       X.DEFAULTS["Review Content"]),
    "Name": (['data-name="([^"]*)"', "^<b>([^<.,]+)[.,]"], X.DEFAULTS["Name"]),
    "Date": (['<time datetime="([^"]+)"', "([0-9]{4}-[0-9]{2}-[0-9]{2})"], X.DEFAULTS["Date"]),
    "Rating": (['data-score="([^"]*)"', "([0-9]+(?:[.][0-9]+)?/[0-9]+)"], X.DEFAULTS["Rating"]),
}
# Field rules for a whole page.
PAGE_RULES = {
    "title": (["<title>([^<]*)</title>"], "No Title"),
    "heading": (["<h1>([^<]*)</h1>", "<title>([^<]*)</title>"], "No Title"),
    "lang": (['<html lang="([^"]+)"'], "unknown"),
    "lead": (['<p class="lead">([^<]*)', "<article><h1>[^<]*</h1><p>(?:<b>)?([^<]+)"], X.DEFAULTS["Review Content"]),
}
TEXT_FIELDS = ("Review Content", "Name", "title", "heading", "lead")
FILTER_RE = "^https?://[^/]+/([^/?#]+)"


def _review_type():
    return F.when(F.col("url").contains("ref="), F.lit("Critic")).otherwise(F.lit("Audience"))


def _source_filter():
    return F.regexp_extract(F.col("url"), FILTER_RE, 1)


SQL_TYPE = "CASE WHEN contains(url, 'ref=') THEN 'Critic' ELSE 'Audience' END"
SQL_FILTER = f"regexp_extract(url, {Q.lit(FILTER_RE)}, 1)"


def sql_unescape(e: str) -> str:
    for k, v in X.ENTITIES:
        e = f"replace({e}, {Q.lit(k)}, {Q.lit(v)})"
    return e


def sql_first_match(e: str, patterns, default) -> str:
    hits = [f"nullif({Q.strip(f'regexp_extract({e}, {Q.lit(p)}, 1)')}, '')" for p in patterns]
    if default is not None:
        hits.append(Q.lit(default))
    return f"coalesce({', '.join(hits)})"


def sql_fields(e: str, rules: dict) -> str:
    out = []
    for name, (pats, default) in rules.items():
        v = sql_first_match(e, pats, default)
        if name in TEXT_FIELDS:
            v = sql_unescape(v)
        out.append(f'{v} AS "{name}"')
    return ", ".join(out)


def spark_fields(df, html: str, rules: dict):
    out = X.extract_fields(df, html, rules)
    return out.withColumns({n: X.unescape_html(n) for n in rules if n in TEXT_FIELDS})


def sql_items(src: str, cols: str) -> str:
    arrays = [f"regexp_extract_all(html, {Q.lit(p)}, 1)" for p in ITEMS]
    chosen = arrays[-1]
    for a in reversed(arrays[:-1]):
        chosen = f"CASE WHEN len({a}) > 0 THEN {a} ELSE {chosen} END"
    return f"""SELECT {cols}, unnest(arr) AS item_html, unnest(generate_series(0, len(arr) - 1)) AS item_index
               FROM (SELECT *, {chosen} AS arr FROM {src})"""


NOT_EMPTY = f"NOT coalesce(regexp_matches(html, {Q.lit(X.EMPTY_STATE)}), false)"

X6_SQL = f"""WITH tagged AS (
    SELECT page_id, {SQL_TYPE} AS "Type", {SQL_FILTER} AS "Source Filter", html FROM v_page WHERE {NOT_EMPTY}),
  items AS ({sql_items('tagged', 'page_id, "Type", "Source Filter"')}),
  fields AS (SELECT page_id, item_index, "Type", "Source Filter", {sql_fields('item_html', ITEM_RULES)} FROM items),
  uniq AS (SELECT * FROM (SELECT *, row_number() OVER (
      PARTITION BY "Source Filter", "Name", "Date", "Review Content"
      ORDER BY page_id, item_index) AS rn FROM fields) WHERE rn = 1)
  SELECT page_id, item_index, "Type", "Source Filter", "Review Content", "Name", "Date", "Rating" FROM uniq"""


@register("X1_extract_fields", oracle(
    f"SELECT page_id, url, {sql_fields('html', PAGE_RULES)} FROM v_page", PAGE))
def x1(spark, sf):
    """Page fields from ordered patterns, first non-empty wins, else the default."""
    return spark_fields(V.v_page(spark, sf), "html", PAGE_RULES).drop("html")


@register("X2_explode_items", oracle(sql_items("v_page", "page_id"), PAGE))
def x2(spark, sf):
    """One row per review item, from the first item pattern with any hit."""
    return X.explode_items(V.v_page(spark, sf).select("page_id", "html"), "html", ITEMS)


X3_SCORE = "[?&]page=([^&#]*)"


@register("X3_audience_rating", oracle(
    f"""SELECT page_id, s AS score,
               CASE WHEN s IS NULL OR s = '' THEN NULL
                    ELSE coalesce(CAST(TRY_CAST(s AS DOUBLE) AS VARCHAR), s) || '/5' END AS rating
        FROM (SELECT page_id, regexp_extract(url, {Q.lit(X3_SCORE)}, 1) AS s FROM v_page)""", PAGE))
def x3(spark, sf):
    """A score attribute (here the page number of the link) as ``<float>/5``."""
    p = V.v_page(spark, sf).select("page_id", F.regexp_extract("url", X3_SCORE, 1).alias("score"))
    return p.withColumn("rating", X.audience_rating("score"))


X4_NAME = "<h1>([^<]*)</h1>"
X4_LINK = "^https?://([^/]+)/"


@register("X4_profile_name", oracle(
    f"""SELECT page_id, coalesce(nullif({Q.strip(f'regexp_extract(html, {Q.lit(X4_NAME)}, 1)')}, ''),
                                 nullif(regexp_extract(url, {Q.lit(X4_LINK)}, 1), '')) AS name
        FROM v_page""", PAGE))
def x4(spark, sf):
    """The shown name (a short heading here), else the name in the link (the host)."""
    p = V.v_page(spark, sf)
    return p.select("page_id", X.profile_name(F.regexp_extract("html", X4_NAME, 1), F.col("url"), X4_LINK).alias("name"))


@register("X5_skip_empty_pages", oracle(f"SELECT page_id, url FROM v_page WHERE {NOT_EMPTY}", PAGE))
def x5(spark, sf):
    """Pages that do not say ``No ... reviews found``."""
    return X.skip_empty_pages(V.v_page(spark, sf)).select("page_id", "url")


def collected(spark, sf):
    return X.collect_reviews(V.v_page(spark, sf), ITEMS, ITEM_RULES, _review_type(), _source_filter(),
                             decode=[n for n in ITEM_RULES if n in TEXT_FIELDS])


@register("X6_collect_reviews", oracle(X6_SQL, PAGE))
def x6(spark, sf):
    """Items -> fields -> tags -> keep first per review."""
    return collected(spark, sf).select("page_id", "item_index", "Type", "Source Filter", "Review Content",
                                       "Name", "Date", "Rating")


@register("A33_type_counts", oracle(f'SELECT "Type", count(*) AS reviews FROM ({X6_SQL}) GROUP BY "Type"', PAGE))
def a33(spark, sf):
    """Collected reviews per type."""
    return X.type_counts(collected(spark, sf))
