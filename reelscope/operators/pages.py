"""Reviews from saved web pages (X1-X6, A33 of the survey; the scraper re-aimed).

The reference drives a browser; here the pages are already a table (``page_id, url,
html``) and extraction is regular expressions in Spark: each field has an ordered list of
patterns and the first that gives non-empty text wins (``coalesce`` of ``nullif``), items
are exploded from the first item pattern with any hit, and the collected reviews go
through the same keep-first fingerprint and per-filter cap as the reference.

Every step is a narrow, whole-stage-codegen expression over one page except the two
that must see all pages: the keep-first on the fingerprint (one ``min_by`` aggregation,
partial before the shuffle) and the per-filter cap (``row_number() <= n``, which Spark
plans with a partial group limit before the shuffle, so a filter that holds a third of
all items still forwards only ``n`` rows per task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions.text import strip_ws
from reelscope.operators.reshape import cap_per_group, unique_reviews

# The defaults the reference writes when a field is not found, and the
# text of a page that has no reviews.
DEFAULTS = {"Review Content": "No Review Text", "Name": "Anonymous", "Date": "No Date", "Rating": "No Rating"}
EMPTY_STATE = "No [^<]*reviews found"

# HTML character references decoded in extracted text (``&amp;`` last, so ``&amp;lt;``
# stays ``&lt;``).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unescape_html(c) -> Column:
    """Decode the common character references, as a browser shows the text."""
    out = _col(c)
    for k, v in ENTITIES:
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def first_match(html, patterns: Sequence[str], default: str | None = None) -> Column:
    """X1 for one field: the first pattern whose group 1 is non-empty (after trimming)."""
    h = _col(html)
    hits = [F.nullif(strip_ws(F.regexp_extract(h, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*hits, F.lit(default)) if default is not None else F.coalesce(*hits)


def extract_fields(df: DataFrame, html: str, rules: dict[str, tuple[Sequence[str], str | None]]) -> DataFrame:
    """One column per field from its ordered patterns and default."""
    return df.withColumns({name: first_match(html, pats, default) for name, (pats, default) in rules.items()})


def explode_items(df: DataFrame, html: str, patterns: Sequence[str], out: str = "item_html") -> DataFrame:
    """Many items per page; the first pattern with any hit decides, one row per hit
    (with its 0-based position). Pages without any hit give no row."""
    h = F.col(html)
    arrays = [F.regexp_extract_all(h, F.lit(p), 1) for p in patterns]
    chosen = arrays[-1]
    for a in reversed(arrays[:-1]):
        chosen = F.when(F.size(a) > 0, a).otherwise(chosen)
    keep = [c for c in df.columns if c != html]
    return df.select(*keep, F.posexplode(chosen).alias("item_index", out))


def audience_rating(score) -> Column:
    """A score attribute as ``<float>/5``; text that is not a number stays as text +
    ``/5``; no attribute gives null."""
    s = _col(score)
    num = s.try_cast("double")
    return F.when(s.isNull() | (s == ""), F.lit(None).cast("string")).otherwise(
        F.concat(F.coalesce(num.cast("string"), s), F.lit("/5")))


def profile_name(name, href, pattern: str = "/profiles/([^/]+)") -> Column:
    """The shown name, else the part of the link after ``/profiles/``."""
    from_link = F.nullif(F.regexp_extract(_col(href), pattern, 1), F.lit(""))
    return F.coalesce(F.nullif(strip_ws(_col(name)), F.lit("")), from_link)


def skip_empty_pages(df: DataFrame, html: str = "html", pattern: str = EMPTY_STATE) -> DataFrame:
    """Leave out pages that say ``No ... reviews found``."""
    return df.filter(~F.coalesce(F.col(html).rlike(pattern), F.lit(False)))


def collect_reviews(pages: DataFrame, item_patterns: Sequence[str], rules: dict, review_type: Column,
                    source_filter: Column, cap: int | None = None,
                    decode: Sequence[str] = ("Review Content", "Name")) -> DataFrame:
    """X5 -> X2 -> X1 -> ``Type`` / ``Source Filter`` tags -> U7 keep-first per review
    -> U8 cap per filter where the caller asks for one. Order is (page, item position). The
    ``decode`` fields are shown as text (character references decoded) before the comparison."""
    p = skip_empty_pages(pages).withColumns({"Type": review_type, "Source Filter": source_filter})
    items = explode_items(p.select("page_id", "Type", "Source Filter", "html"), "html", item_patterns)
    fields = extract_fields(items, "item_html", rules).drop("item_html")
    fields = fields.withColumns({c: unescape_html(c) for c in decode if c in rules})
    unique = unique_reviews(fields, "Source Filter", "Name", "Date", "Review Content",
                            F.struct("page_id", "item_index"))
    if cap is None:
        return unique
    return cap_per_group(unique, ["Source Filter"], cap, [F.col("page_id"), F.col("item_index")])


def type_counts(reviews: DataFrame, col: str = "Type") -> DataFrame:
    """Reviews per type (Audience / Critic)."""
    return reviews.groupBy(col).agg(F.count(F.lit(1)).alias("reviews"))
