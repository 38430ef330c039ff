"""Checked queries for the remaining inventory IDs: N11, N12, N14-N16, J6, Z5, A21, A25,
A26, A31, W5, U3, U4, O2, O3, F1, F3, S3 and A17 (rows only)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions import numbers as N
from reelscope.functions.dates import days_since_first
from reelscope.functions.text import TOKEN_PATTERN, split_boundary
from reelscope.operators import disconnect as D
from reelscope.operators import profile as P
from reelscope.operators import reshape as R
from reelscope.operators import scoring as SC
from reelscope.operators import sentences as S
from reelscope.operators import sentiment as A
from reelscope.plans import cases_sentiment  # noqa: F401  (A11 must be registered first)
from reelscope.operators import timeline as TL
from reelscope.operators import topics as M
from reelscope.operators.ordering import ordered_index
from reelscope.plans import cases_disconnect as CD
from reelscope.plans import cases_topics as CT
from reelscope.plans import sqlfrag as Q
from reelscope.plans import views as V
from reelscope.plans.catalog import REGISTRY, oracle, register
from reelscope.sources import files as SF
from reelscope.sources.files import movie_from_path

REV = [V.SQL_V_REV]
DOC = [V.SQL_V_DOC]
REV_COLS = ["review_id", "movie_name", "username", "date", "review_text", "rating", "source"]


# ------------------------------------------------------------------ disconnect pieces

@register("N11_review_score", CD._wrap(
    "SELECT movie_name, review_index, sum_score, num_sentences, nmd_score, "
    "50.0 + 50.0 / num_sentences * sum_score AS signed_score FROM scores",
    doubles=("sum_score", "nmd_score", "signed_score")))
def n11(spark, sf):
    """Review score ``abs(50 + 50/n * sum)`` and the unfolded value (``fold=False``)."""
    s = D.review_sentiment_score(V.v_sent(spark, sf))
    return s.withColumn("signed_score", N.review_score(F.col("sum_score"), F.col("num_sentences"), fold=False))


@register("N12_disconnect", CD._wrap(
    "SELECT movie_name, review_index, mss, user_rating, abs(mss - user_rating) AS nmd_difference FROM final",
    doubles=("mss", "user_rating", "nmd_difference")))
def n12(spark, sf):
    """``abs(mss - rating)`` per review."""
    f = CD._z5(spark, sf)["final"]
    return f.select("movie_name", "review_index", "mss", "user_rating",
                    N.disconnect(F.col("mss"), F.col("user_rating")).alias("nmd_difference"))


@register("N14_magnitude_range", CD._wrap(
    "SELECT DISTINCT significance_category, nmd_magnitude_range FROM sig_table"))
def n14(spark, sf):
    """Band -> magnitude label, for the bands that occur."""
    f = CD._z5(spark, sf)["final"]
    return f.select("significance_category").distinct().withColumn(
        "nmd_magnitude_range", N.magnitude_range(F.col("significance_category")))


_R = CD._PEARSON


@register("N15_correlation_strength", CD._wrap(
    f"""SELECT movie_name, r AS pearson_r,
               CASE WHEN r > 0.7 THEN 'Strong positive correlation' WHEN r > 0.3 THEN 'Moderate positive correlation'
                    WHEN r > -0.3 THEN 'Weak or no correlation' WHEN r > -0.7 THEN 'Moderate negative correlation'
                    ELSE 'Strong negative correlation' END AS strength
        FROM (SELECT movie_name, {_R} AS r FROM final GROUP BY movie_name)""", doubles=("pearson_r",)))
def n15(spark, sf):
    """Pearson r of rating and text score per movie, with its interpretation."""
    r = D.pearson(CD._z5(spark, sf)["final"], "user_rating", "mss", ["movie_name"]).drop("n_rows")
    return r.withColumn("strength", N.correlation_strength(F.col("pearson_r")))


@register("J6_assemble_by_key", CD._wrap(
    f"""SELECT coalesce(a.movie_name, b.movie_name) AS movie_name,
               coalesce(a.significance_category, b.significance_category) AS significance_category,
               a.percentage, b.pearson_r
        FROM (SELECT movie_name, significance_category,
                     CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY movie_name) * 100.0 AS percentage
              FROM final GROUP BY movie_name, significance_category) a
        FULL JOIN (SELECT movie_name, significance_category, {_R} AS pearson_r FROM final
                   GROUP BY movie_name, significance_category) b
          ON a.movie_name = b.movie_name AND a.significance_category = b.significance_category""",
    doubles=("percentage", "pearson_r")))
def j6(spark, sf):
    """Two per-band results (share and r) side by side, aligned on (movie, band)."""
    f = CD._z5(spark, sf)["final"]
    keys = ["movie_name", "significance_category"]
    share = D.category_share(f, "significance_category", ["movie_name"]).drop("n")
    corr = D.pearson(f, "user_rating", "mss", keys).drop("n_rows")
    return share.join(corr, keys, "full")


@register("Z5_narrative_metric_disconnect", CD._wrap(
    "SELECT f.*, t.percentage AS band_percentage, t.pearson_r AS band_pearson_r "
    "FROM final f LEFT JOIN sig_table t USING (movie_name, significance_category)",
    doubles=("user_rating", "sum_score", "mss", "avg_sentiment_score", "positive_percentage", "nmd_difference",
             "band_percentage", "band_pearson_r"), stamps=("review_date",)))
def z5(spark, sf):
    """Z5 (N10 -> A1 -> J1 -> J2 -> A4 -> J3 -> P1 -> N12 -> N13 -> A20-A24): the final
    review table with its band's share and r."""
    out = CD._z5(spark, sf)
    t = out["table"].select("movie_name", "significance_category", F.col("percentage").alias("band_percentage"),
                            F.col("pearson_r").alias("band_pearson_r"))
    return out["final"].join(t, ["movie_name", "significance_category"], "left")


# ------------------------------------------------------------------ time and counts

_DAYS = "floor((epoch(date) - epoch(min(date) OVER (PARTITION BY movie_name))) / 86400)"


def _nan_null(e: str) -> str:
    return f"(CASE WHEN isnan({e}) THEN NULL ELSE {e} END)"


@register("A21_linear_trend", oracle(
    f"""SELECT movie_name, {_nan_null('regr_slope(rating, days)')} AS slope,
               {_nan_null('regr_intercept(rating, days)')} AS intercept
        FROM (SELECT movie_name, rating, {_DAYS} AS days FROM v_rev WHERE date IS NOT NULL) GROUP BY movie_name""",
    REV, doubles=("slope", "intercept")))
def a21(spark, sf):
    """Least-squares slope and intercept of rating on days since the movie's first review."""
    r = days_since_first(V.v_rev(spark, sf).filter(F.col("date").isNotNull()), "movie_name", "date", "days")
    return TL.linear_trend(r, "days", "rating", ["movie_name"])


@register("A25_range_summary", oracle(
    """SELECT movie_name, min(date) AS first_date, max(date) AS last_date,
              count(DISTINCT CAST(date AS DATE)) AS days_with_reviews, count(*) AS reviews,
              avg(rating) AS mean, min(rating) AS min, max(rating) AS max
       FROM v_rev WHERE date IS NOT NULL GROUP BY movie_name""",
    REV, doubles=("mean", "min", "max"), stamps=("first_date", "last_date")))
def a25(spark, sf):
    """First and last date, days with reviews, reviews, mean/min/max rating per movie."""
    return TL.range_summary(V.v_rev(spark, sf).filter(F.col("date").isNotNull()), "rating", ["movie_name"])


def _a26_sql() -> str:
    pieces = Q.split_punct("text")
    sents = f"""SELECT lang, doc_id FROM (
        SELECT lang, doc_id, unnest({pieces}) AS s FROM v_doc WHERE text IS NOT NULL AND text <> '' AND text <> 'nan')
        WHERE {Q.words('s')} >= 2"""
    per = f"""SELECT r.lang AS movie_name, r.reviews, coalesce(s.sentences, 0) AS sentences
              FROM (SELECT lang, count(*) AS reviews FROM v_doc GROUP BY lang) r
              LEFT JOIN (SELECT lang, count(*) AS sentences FROM ({sents}) GROUP BY lang) s USING (lang)"""
    return oracle(f"""SELECT movie_name, reviews, sentences, CAST(sentences AS DOUBLE) / reviews AS sentences_per_review
                      FROM ({per}) UNION ALL
                      SELECT 'ALL', sum(reviews), sum(sentences), CAST(sum(sentences) AS DOUBLE) / sum(reviews)
                      FROM ({per})""", DOC, doubles=("sentences_per_review",))


@register("A26_sentences_per_review", _a26_sql())
def a26(spark, sf):
    """Reviews, sentences (T4) and sentences per review, per language and in total."""
    d = V.v_doc(spark, sf).select("doc_id", F.col("lang").alias("movie_name"), "text")
    sents = S.split_sentences_punct(d, text="text")
    return S.sentences_per_review(d, sents, "movie_name", "doc_id")


@register("W5_number_reviews", oracle(
    "SELECT review_id, movie_name, row_number() OVER (PARTITION BY movie_name ORDER BY review_id) - 1 AS review_index "
    "FROM v_rev", REV))
def w5(spark, sf):
    """0-based review index per movie in id order (skew-safe numbering)."""
    r = V.v_rev(spark, sf).select("review_id", "movie_name")
    return ordered_index(r, ["movie_name"], ["review_id"], out="review_index")


# ------------------------------------------------------------------ unions

_U3_ORDER = ["movie_name", "username", "date", "review_text", "rating", "source"]


@register("U3_union_movies", oracle(
    " UNION ALL ".join(f"SELECT {', '.join(_U3_ORDER)} FROM v_rev WHERE {w}"
                       for w in ("source = 'imdb'", "source = 'ltbx'", "source = 'rt'", "source IS NULL")),
    REV, doubles=("rating",), stamps=("date",)))
def u3(spark, sf):
    """UNION ALL of separately built review tables (one per site here) in a fixed
    column order; an empty part adds nothing."""
    r = V.v_rev(spark, sf)
    parts = [r.filter(F.col("source") == s) for s in ("imdb", "ltbx", "rt")] + [r.filter(F.col("source").isNull())]
    return R.union_all([p.select(*_U3_ORDER) for p in parts])


def _u4_sql() -> str:
    def sents(src, movie, rid, text):
        return f"""SELECT movie_name, review_id, CAST(pos AS BIGINT) AS sentence_num, sentence FROM (
            SELECT {movie} AS movie_name, {rid} AS review_id, unnest(p) AS sentence,
                   generate_subscripts(p, 1) AS pos
            FROM (SELECT *, {Q.split_punct(text)} AS p FROM {src}
                  WHERE {text} IS NOT NULL AND {text} <> '' AND {text} <> 'nan'))
            WHERE {Q.words('sentence')} >= 2"""
    return oracle(sents("v_doc", "'doc ' || lang", "doc_id", "text") + " UNION ALL "
                  + sents("v_turn", "'chat ' || CAST(conv_id AS VARCHAR)", "turn", "text"), [V.SQL_V_DOC, V.SQL_V_TURN])


@register("U4_union_sentences", _u4_sql())
def u4(spark, sf):
    """U4: sentence tables of two corpora in one, keyed by (movie_name, review_id)."""
    d = V.v_doc(spark, sf).select(F.concat(F.lit("doc "), F.col("lang")).alias("movie_name"),
                                  F.col("doc_id").alias("review_id"), "text")
    c = V.v_turn(spark, sf).select(F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("movie_name"),
                                   F.col("turn").alias("review_id"), "text")
    parts = [S.split_sentences_punct(x, text="text") for x in (d, c)]
    return R.union_all(parts).select("movie_name", "review_id", F.col("sentence_num").cast("long"), "sentence")


# ------------------------------------------------------------------ sorts

@register("O2_sort_summary")
def o2(spark, sf):
    """O2: per-movie summaries (A11), most rows first, with their place."""
    return A.sort_summary(REGISTRY["A11_movie_summary"].build(spark, sf), "rank")


@register("O3_sort_topics")
def o3(spark, sf):
    """O3: topic summary ordered by movie and topic id, with the place."""
    return M.sort_topics(CT._a28_spark(spark, sf).select(*CT.A28_COLS), CT.KEYS, rank="rank")


@register("A31_movie_overview", CT._topics_sql(
    "SELECT movie_name, total_reviews, total_sentences, reviews_positive_percentage AS review_positive_pct, "
    "reviews_negative_percentage AS review_negative_pct, sentences_positive_percentage AS sentence_positive_pct, "
    "sentences_negative_percentage AS sentence_negative_pct, total_topics AS topics_found FROM a30",
    doubles=("review_positive_pct", "review_negative_pct", "sentence_positive_pct", "sentence_negative_pct")))
def a31(spark, sf):
    """The flat overview row of every movie's topic statistics."""
    return M.movie_overview(CT._a30_spark(spark, sf), CT.KEYS)


# ------------------------------------------------------------------ scoring, sources, schemas

def make_lexicon_predict():
    """A stand-in model for F1: the F2 lexicon as a batch function over numpy arrays (one
    call per Arrow batch; the word sets are built once per Python worker)."""
    import regex
    word = regex.compile(TOKEN_PATTERN.replace("(?U)", ""))
    pos, neg = frozenset(SC.POSITIVE_WORDS), frozenset(SC.NEGATIVE_WORDS)

    def predict(texts: np.ndarray) -> np.ndarray:
        out = np.empty((len(texts), 3), dtype=np.float64)
        for i, t in enumerate(texts):
            toks = word.findall(str(t).lower())
            out[i, 0] = sum(1 for w in toks if w in neg)
            out[i, 1] = SC.NEUTRAL_LOGIT
            out[i, 2] = sum(1 for w in toks if w in pos)
        return out
    return predict


@register("F1_score_sentences")
def f1(spark, sf):
    """F1 + F3: T4 sentences of whole documents scored by a batch model function
    (``predict_batch_udf``, Arrow batches of 32); here the model is the F2 lexicon, so the
    result must equal F2's."""
    s = S.split_sentences_punct(V.v_doc(spark, sf).select("doc_id", "text"), text="text", out="sentence")
    return SC.score_sentences(s, "sentence", make_lexicon_predict, batch_size=32).drop("sentence")


@register("F3_score_missing_texts", oracle(
    f"SELECT doc_id, {Q.strip('coalesce(text, ' + chr(39) + chr(39) + ')')} = '' AS missing FROM v_doc", DOC))
def f3(spark, sf):
    """which texts are not sent to a model (null or blank)."""
    d = V.v_doc(spark, sf)
    return d.select("doc_id", SC.score_missing_texts(d, "text").alias("missing"))


S3_SQL_STEM = ("regexp_replace(regexp_extract(p, '([^/]+)$', 1), "
               "'(_reviews_sentiment\\.csv|_reviews\\.csv|\\.csv)$', '')")


@register("S3_movie_from_path", oracle(
    f"""SELECT doc_id, p AS path,
               array_to_string(list_transform(string_split(replace({S3_SQL_STEM}, '_', ' '), ' '),
                 lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS movie
        FROM (SELECT doc_id, '/data/scored/' || lower(lang) || '_' || source || '_reviews_sentiment.csv' AS p
              FROM v_doc)""", DOC))
def s3(spark, sf):
    """S3: movie name from a file path (a path per document, built from its language and source)."""
    d = V.v_doc(spark, sf).select("doc_id", F.concat(F.lit("/data/scored/"), F.lower("lang"), F.lit("_"),
                                                     F.col("source"), F.lit("_reviews_sentiment.csv")).alias("path"))
    return d.withColumn("movie", movie_from_path(F.col("path")))


def _odd_text():
    """Texts with what CSV and JSON must escape: doubled quotes, commas, line breaks, blanks at both ends."""
    return F.concat(F.lit(' "'), F.replace("text", F.lit(". "), F.lit('."\n, "')), F.lit('" '))


ODD_TEXT_SQL = "' \"' || replace(text, '. ', '.\"' || chr(10) || ', \"') || '\" '"


@register("S6_combined_csv", oracle(
    f"SELECT lang AS movie_name, source AS username, doc_id AS date, {ODD_TEXT_SQL} AS review_text, "
    "CAST(doc_id % 101 AS DOUBLE) / 2 AS rating, nullif(source, '') AS source, CAST(NULL AS VARCHAR) AS broken FROM v_doc",
    DOC, doubles=("rating",)))
def s6(spark, sf):
    """S5 + S6: documents as combined CSV records in the fixed column order, read back under the declared schema."""
    d = V.v_doc(spark, sf).select(
        F.col("lang").alias("movie_name"), F.col("source").alias("username"), F.col("doc_id").alias("date"),
        _odd_text().alias("review_text"), ((F.col("doc_id") % 101).cast("double") / 2).alias("rating"), "source")
    back = SF.read_csv_lines(SF.csv_lines(d, SF.COMBINED_ORDER), d.select(*SF.COMBINED_ORDER).schema)
    return back.withColumnRenamed(SF.CORRUPT, "broken")


@register("S7_summary_json", oracle(
    "SELECT lang, documents, source, n, longest, last_text, CAST(NULL AS VARCHAR) AS broken FROM ("
    "SELECT lang, source, count(*) AS n FROM v_doc WHERE source IS NOT NULL GROUP BY ALL) JOIN ("
    "SELECT lang, count(*) AS documents, max(length(text)) AS longest, "
    f"arg_max({ODD_TEXT_SQL}, doc_id) FILTER (WHERE text IS NOT NULL) AS last_text "
    "FROM v_doc GROUP BY lang) USING (lang)", DOC))
def s7(spark, sf):
    """One JSON record per language with a struct and a map inside, read back under the declared schema."""
    d = V.v_doc(spark, sf)
    per = d.filter(F.col("source").isNotNull()).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    maps = per.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("sources"))  # one entry per source
    rest = d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.struct(F.max(F.length("text")).cast("long").alias("longest"),
                 F.max_by(_odd_text(), F.when(F.col("text").isNotNull(), F.col("doc_id"))).alias("last_text")).alias("texts"))
    records = rest.join(maps, "lang")
    back = SF.read_json_lines(SF.json_lines(records), records.schema)
    return back.select("lang", "documents", F.explode("sources").alias("source", "n"), "texts.longest", "texts.last_text",
                       F.col(SF.CORRUPT).alias("broken"))


@register("S8_result_tables", oracle(
    f"SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS position, unnest(p) AS sentence, "
    f"CAST(NULL AS VARCHAR) AS broken FROM (SELECT doc_id, {Q.split_boundary(ODD_TEXT_SQL)} AS p FROM v_doc)", DOC))
def s8(spark, sf):
    """A result table with a list column as CSV records (the list as JSON text), read back and unfolded."""
    d = V.v_doc(spark, sf).select("doc_id", split_boundary(_odd_text()).alias("sentences"))
    flat = T.StructType([d.schema["doc_id"], T.StructField("sentences", T.StringType())])
    back = SF.read_csv_lines(SF.csv_lines(d), flat)
    return R.explode_list(back, F.from_json("sentences", "array<string>"), ["doc_id", SF.CORRUPT], "sentence", "position") \
            .withColumnRenamed(SF.CORRUPT, "broken")


@register("A17_schema_report")
def a17(spark, sf):
    """Column -> type of every driver table (schemas only, no data read)."""
    return P.schema_report(spark, {t: V.table(spark, sf, t) for t in V.TABLES})


REGISTRY["F1_score_sentences"].sql = REGISTRY["F2_lexicon_scorer"].sql
REGISTRY["O2_sort_summary"].sql = (
    "SELECT *, row_number() OVER (ORDER BY coalesce(movie = 'All Movies', false), total_rows DESC, movie NULLS FIRST) AS rank "
    f"FROM ({REGISTRY['A11_movie_summary'].sql})")
REGISTRY["O3_sort_topics"].sql = (
    "SELECT *, row_number() OVER (ORDER BY movie_name NULLS FIRST, topic NULLS FIRST) AS rank "
    f"FROM ({REGISTRY['A28_topic_sentiment'].sql})")
