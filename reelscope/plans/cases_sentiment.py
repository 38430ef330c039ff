"""Checked queries for sentiment summaries, votes and scoring
(A2, A5-A11, A26, A27, A34, A35, F2, F3, P11, O2, Z2, Z3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.operators import disconnect as D
from reelscope.operators import reshape as R
from reelscope.operators import scoring as SC
from reelscope.operators import sentences as S
from reelscope.operators import sentiment as A
from reelscope.plans import sqlfrag as Q
from reelscope.plans import views as V
from reelscope.plans.catalog import oracle, register
from reelscope.plans.cases_functions import _sql_label
from reelscope.session import cut_lineage

RUN_STAMP = "2025-12-18 00:00:00"  # the summaries' run stamp (a parameter, never the clock)
SCORED = [V.SQL_V_SCORED]
LABELS = ["positive", "neutral", "negative"]


def _lex_sql(text: str) -> dict[str, str]:
    """F2 in SQL: logits, softmax, argmax (first on ties), label and confidence."""
    pos = "[" + ", ".join(Q.lit(w) for w in SC.POSITIVE_WORDS) + "]"
    neg = "[" + ", ".join(Q.lit(w) for w in SC.NEGATIVE_WORDS) + "]"
    toks = Q.tokens(text)
    n_pos = f"CAST(len(list_filter({toks}, lambda t: list_contains({pos}, t))) AS DOUBLE)"
    n_neg = f"CAST(len(list_filter({toks}, lambda t: list_contains({neg}, t))) AS DOUBLE)"
    m = f"greatest({n_neg}, {SC.NEUTRAL_LOGIT}, {n_pos})"
    e0, e1, e2 = f"exp({n_neg} - {m})", f"exp({SC.NEUTRAL_LOGIT} - {m})", f"exp({n_pos} - {m})"
    tot = f"({e0} + {e1} + {e2})"
    p0, p1, p2 = f"({e0} / {tot})", f"({e1} / {tot})", f"({e2} / {tot})"
    label = (f"CASE WHEN {p0} >= {p1} AND {p0} >= {p2} THEN 'negative' WHEN {p1} >= {p2} THEN 'neutral' "
             f"ELSE 'positive' END")
    return {"sentiment": label, "confidence": f"greatest({p0}, {p1}, {p2})",
            "prob_negative": p0, "prob_neutral": p1, "prob_positive": p2}


def _std(e: str) -> str:
    return _sql_label(e, True)


def _he(e: str, d: int) -> str:
    return Q.half_even(e, d)


# ------------------------------------------------------------------ F2 / F3 / P11

@register("F2_lexicon_scorer")
def f2(spark, sf):
    """F2 + F3: the built-in lexicon scorer on T4 sentences of whole documents."""
    s = S.split_sentences_punct(V.v_doc(spark, sf).select("doc_id", "text"), text="text", out="sentence")
    return SC.lexicon_scorer(s, "sentence").drop("sentence")


def _f2_sql():
    lx = _lex_sql("sentence")
    cols = ", ".join(f"{v} AS {k}" for k, v in lx.items())
    return oracle(f"""SELECT doc_id, sentence_num, {cols} FROM (
          SELECT doc_id, unnest(pieces) AS sentence, CAST(generate_subscripts(pieces, 1) AS BIGINT) AS sentence_num
          FROM (SELECT doc_id, {Q.split_punct('text')} AS pieces FROM v_doc
                WHERE text IS NOT NULL AND text <> '' AND text <> 'nan'))
        WHERE {Q.words('sentence')} >= 2""", [V.SQL_V_DOC],
                  doubles=("confidence", "prob_negative", "prob_neutral", "prob_positive"))


@register("P11_rescore_mode")
def p11(spark, sf):
    """P11 (mode 3): documents with a label keep it, the others are scored (F2)."""
    d = V.v_label(spark, sf).select("doc_id", "text", "sentiment")
    out = R.rescore_mode(d, 3, lambda x: SC.lexicon_scorer(x, "text"), label="sentiment")
    return out.select("doc_id", "sentiment", "confidence", F.col("sentiment").isNull().alias("missing"))


def _p11_sql():
    lx = _lex_sql("text")
    return oracle(f"""SELECT doc_id, sentiment, NULL::DOUBLE AS confidence, false AS missing FROM v_label WHERE sentiment IS NOT NULL
        UNION ALL
        SELECT doc_id, CASE WHEN {Q.strip("coalesce(text, '')")} = '' THEN NULL ELSE {lx['sentiment']} END,
               CASE WHEN {Q.strip("coalesce(text, '')")} = '' THEN NULL ELSE {lx['confidence']} END,
               {Q.strip("coalesce(text, '')")} = '' AS missing
        FROM v_label WHERE sentiment IS NULL""", [V.SQL_V_LABEL], doubles=("confidence",))


# ------------------------------------------------------------------ A2 vote (T5 + F2 + T6)

def _scored_boundary(spark, sf):
    d = V.v_doc(spark, sf).select("doc_id", "text")
    s = S.split_sentences_boundary(d, text="text", keep_empty=True)
    s = SC.lexicon_scorer(s, "sentence_text").withColumnsRenamed(
        {"sentiment": "sentiment_label", "confidence": "sentiment_score"})
    return s.select("doc_id", "sentence_index", "sentiment_label", "sentiment_score")


@register("A2_review_vote")
def a2(spark, sf):
    """A2 + T6: per document the majority sentence label (ties -> first seen), mean score,
    count, running sentence positions and label counts; documents without sentences keep
    a placeholder row."""
    s = cut_lineage(_scored_boundary(spark, sf))  # the numbering reads its rows several times, the texts only once
    real = S.global_sentence_index(s.filter(F.col("sentence_index").isNotNull()), ["doc_id"])
    empty = s.filter(F.col("sentence_index").isNull()).withColumn("global_index", F.lit(None).cast("long"))
    v = S.review_vote(real.unionByName(empty), ["doc_id"])
    dist = F.array_join(F.array_sort(F.transform(F.map_entries("sentiment_distribution"),
                                                 lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return v.select("doc_id", "sentiment_label", "sentiment_score", "sentence_count",
                    F.array_join(F.transform("sentence_indices", lambda x: x.cast("string")), ",").alias("sentence_indices"),
                    dist.alias("sentiment_distribution"))


def _a2_sql():
    lx = _lex_sql("sentence_text")
    return oracle(f"""
WITH v_doc AS (SELECT doc_id, text FROM documents),
pieces AS (SELECT doc_id, {Q.split_boundary('text')} AS pieces FROM v_doc),
sents AS (SELECT doc_id, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS sentence_index, unnest(pieces) AS sentence_text
          FROM pieces),
scored AS (SELECT doc_id, sentence_index, {lx['sentiment']} AS sentiment_label, {lx['confidence']} AS sentiment_score
           FROM sents),
g AS (SELECT *, row_number() OVER (ORDER BY doc_id, sentence_index) - 1 AS global_index FROM scored),
per_label AS (SELECT doc_id, sentiment_label, count(*) AS n, min(sentence_index) AS first FROM g
              GROUP BY doc_id, sentiment_label),
votes AS (SELECT doc_id, sentiment_label FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM per_label) WHERE rn = 1),
dist AS (SELECT doc_id, string_agg(sentiment_label || ':' || CAST(n AS VARCHAR), ',' ORDER BY sentiment_label || ':' || CAST(n AS VARCHAR)) AS sentiment_distribution
         FROM per_label GROUP BY doc_id),
stats AS (SELECT doc_id, avg(sentiment_score) AS sentiment_score, count(*) AS sentence_count, min(global_index) AS g0
          FROM g GROUP BY doc_id)
SELECT v.doc_id, v.sentiment_label, s.sentiment_score, s.sentence_count,
       array_to_string(range(s.g0, s.g0 + s.sentence_count), ',') AS sentence_indices, d.sentiment_distribution
FROM votes v JOIN stats s USING (doc_id) JOIN dist d USING (doc_id)
UNION ALL
SELECT doc_id, 'neutral', 0.0, 0, '', '' FROM pieces WHERE len(pieces) = 0""", [], doubles=("sentiment_score",))


# ------------------------------------------------------------------ per-movie summaries

def _scored(spark, sf):
    return A.with_standard_label(V.v_scored(spark, sf))


@register("A6_label_distribution")
def a6(spark, sf):
    """Count and % per label per movie (after N5)."""
    return _scored(spark, sf).groupBy("movie_name").agg(F.count(F.lit(1)).alias("total_rows"),
                                                        *A.label_distribution_aggs())


@register("A7_confidence_stats")
def a7(spark, sf):
    """Confidence mean/min/max and mean per label, 3 digits."""
    return _scored(spark, sf).groupBy("movie_name").agg(*A.confidence_aggs())


@register("A8_rating_stats")
def a8(spark, sf):
    """Numeric ratings only: mean (2 digits), min, max, mean per label."""
    return _scored(spark, sf).groupBy("movie_name").agg(*A.rating_aggs())


@register("A9_rating_stats_basic", oracle(
    f"SELECT movie_name, {_he('avg(rating)', 1)} AS avg_rating, CAST(trunc(min(rating)) AS BIGINT) AS min_rating, "
    "CAST(trunc(max(rating)) AS BIGINT) AS max_rating FROM v_rev GROUP BY movie_name", [V.SQL_V_REV],
    doubles=("avg_rating",)))
def a9(spark, sf):
    """Review-level rating stats per movie."""
    return V.v_rev(spark, sf).groupBy("movie_name").agg(*A.rating_aggs_basic())


@register("A10_source_counts", oracle(
    "SELECT movie_name, source, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY movie_name) * 100.0 AS share "
    "FROM v_rev GROUP BY movie_name, source", [V.SQL_V_REV], doubles=("share",)))
def a10(spark, sf):
    """A10: reviews per source and share, per movie."""
    return A.source_counts(V.v_rev(spark, sf), ["movie_name"])


def _a11_spark(spark, sf):
    s = A.movie_summary(V.v_scored(spark, sf), RUN_STAMP)
    srcs = F.array_join(F.array_sort(F.transform(F.map_entries("sources"),
                                                 lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))), ",")
    return s.withColumn("sources", srcs)


@register("A11_movie_summary")
def a11(spark, sf):
    """The movie summary record (sources map shown as text)."""
    return _a11_spark(spark, sf)


@register("A27_master_summary")
def a27(spark, sf):
    """A27 + O2: one row per movie, largest first, plus the unweighted All Movies row."""
    return A.sort_summary(A.master_summary(A.movie_summary(V.v_scored(spark, sf), RUN_STAMP), RUN_STAMP))


_STD_CTE = (f"s AS (SELECT *, {_std('sentiment')} AS sentiment_std, {Q.to_double('rating')} AS r FROM v_scored)")


def _a6_cols():
    out = []
    for lab in LABELS:
        c = f"count(*) FILTER (WHERE sentiment_std = '{lab}')"
        out += [f"{c} AS {lab}_count", f"{_he(f'{c} / count(*) * 100.0', 2)} AS {lab}_percentage"]
    return out


def _a7_cols():
    out = [f"{_he('avg(confidence)', 3)} AS avg_confidence", f"{_he('min(confidence)', 3)} AS min_confidence",
           f"{_he('max(confidence)', 3)} AS max_confidence"]
    out += [f"{_he(f'avg(confidence) FILTER (WHERE sentiment_std = {Q.lit(lab)})', 3)} AS avg_confidence_{lab}"
            for lab in LABELS]
    return out


def _a8_cols():
    out = [f"{_he('avg(r)', 2)} AS avg_rating", "min(r) AS min_rating", "max(r) AS max_rating"]
    out += [f"{_he(f'avg(r) FILTER (WHERE sentiment_std = {Q.lit(lab)})', 2)} AS avg_rating_{lab}" for lab in LABELS]
    return out


_D6 = tuple(f"{lab}_percentage" for lab in LABELS)
_D7 = ("avg_confidence", "min_confidence", "max_confidence") + tuple(f"avg_confidence_{lab}" for lab in LABELS)
_D8 = ("avg_rating", "min_rating", "max_rating") + tuple(f"avg_rating_{lab}" for lab in LABELS)


def _summary_sql():
    return (f"SELECT movie_name AS movie, count(*) AS total_rows, '{RUN_STAMP}' AS analysis_date, "
            + ", ".join(_a6_cols() + _a7_cols() + _a8_cols())
            + ", (SELECT string_agg(source || ':' || CAST(n AS VARCHAR), ',' ORDER BY source || ':' || CAST(n AS VARCHAR)) "
              "FROM (SELECT source, count(*) AS n FROM s s2 WHERE s2.movie_name = s.movie_name AND source IS NOT NULL "
              "GROUP BY source)) AS sources FROM s GROUP BY movie_name")


def _with(select: str, doubles=()) -> str:
    inner = oracle("SELECT * FROM out_q", [], doubles=doubles)
    return "WITH " + V.SQL_V_SCORED + ", " + _STD_CTE + f", out_q AS ({select})\n" + inner


def _a27_sql():
    per = ("SELECT movie, total_rows, " + ", ".join(f"{lab}_count, {lab}_percentage" for lab in LABELS)
           + ", coalesce(avg_confidence, 0.0) AS avg_confidence, coalesce(avg_rating, 0.0) AS avg_rating, "
             "analysis_date FROM summ")
    tot = ("SELECT 'All Movies', sum(total_rows), "
           + ", ".join(f"sum({lab}_count), {_he(f'avg({lab}_percentage)', 2)}" for lab in LABELS)
           + f", {_he('avg(avg_confidence)', 3)}, {_he('avg(avg_rating)', 2)}, '{RUN_STAMP}' FROM per")
    return (f"WITH {V.SQL_V_SCORED}, {_STD_CTE}, summ AS ({_summary_sql()}), per AS ({per})\n"
            + oracle(f"SELECT movie, total_rows, {', '.join(f'{lab}_count, {lab}_percentage' for lab in LABELS)}, "
                     f"avg_confidence, avg_rating, analysis_date FROM per UNION ALL "
                     f"SELECT * FROM ({tot})", [], doubles=_D6 + ("avg_confidence", "avg_rating")))


@register("A5_unique_reviews")
def a5(spark, sf):
    """A5: per (review, user, day) the first rating and the mean score; null keys dropped."""
    s = V.v_sent(spark, sf).select("review_index", "sentence_index", "sentiment_score")
    c = D.attach_metadata(s, V.v_meta(spark, sf), by_position=True).withColumn("day", F.to_date("date"))
    return A.unique_reviews(c, ["review_index", "username", "day"], "rating", "sentiment_score", "sentence_index")


def _a5_sql():
    return oracle("""SELECT review_index, username, day,
                            arg_min(rating, sentence_index) FILTER (WHERE rating IS NOT NULL) AS rating,
                            round(avg(sentiment_score), 9) AS mean_score, count(*) AS n_rows
                     FROM (SELECT s.review_index, s.sentence_index, s.sentiment_score, m.username, m.rating,
                                  CAST(m.date AS DATE) AS day
                           FROM v_sent s JOIN v_meta m
                             ON s.review_index = m.review_id AND s.sentence_index = m.sentence_num - 1)
                     WHERE review_index IS NOT NULL AND username IS NOT NULL AND day IS NOT NULL
                     GROUP BY review_index, username, day""",
                  [V.SQL_V_SENT, V.SQL_V_META], doubles=("rating", "mean_score"), dates=("day",))


@register("A34_score_histogram", oracle(
    f"""SELECT movie_name, score_bin, sentiment_label, n, sum(n) OVER (PARTITION BY movie_name, sentiment_label) AS label_total
        FROM (SELECT movie_name, CAST(least(greatest(floor(sentiment_score / CAST({1 / 30!r} AS DOUBLE)) + 1, 1), 30) AS BIGINT)
                     AS score_bin, sentiment_label, count(*) AS n FROM v_sent GROUP BY ALL)""",
    [V.SQL_V_SENT]).replace("sum(n) OVER", "CAST(sum(n) OVER").replace(
        "AS label_total", "AS BIGINT) AS label_total"))
def a34(spark, sf):
    """A34 + N20: sentence count per (movie, score bin, label) with the label total."""
    return A.score_histogram(V.v_sent(spark, sf), by=["movie_name"])


_REV_COLS_TEXT = "review_id, movie_name, username, date, review_text, rating, source, raw_date, raw_rating"


@register("A35_table_glance", oracle(
    "SELECT 'rows' AS item, CAST(count(*) AS DOUBLE) AS number, NULL AS text FROM v_rev UNION ALL "
    "SELECT 'min_rating', min(rating), NULL FROM v_rev UNION ALL SELECT 'max_rating', max(rating), NULL FROM v_rev "
    f"UNION ALL SELECT 'columns', NULL, '{_REV_COLS_TEXT}' UNION ALL "
    "SELECT * FROM (SELECT DISTINCT 'source', NULL::DOUBLE, source FROM v_rev WHERE source IS NOT NULL "
    "ORDER BY 3 LIMIT 5)", [V.SQL_V_REV], doubles=("number",)))
def a35(spark, sf):
    """A glance at the review table."""
    return A.table_glance(V.v_rev(spark, sf))


# ------------------------------------------------------------------ sentence table

@register("Z2_sentence_table")
def z2(spark, sf):
    """Z2 (P2 -> T4 -> U4 -> A26): texts per language, their sentences and the mean."""
    d = R.drop_empty_text(V.v_doc(spark, sf).select("doc_id", "lang", "text"), "text")
    s = S.split_sentences_punct(d, text="text", out="sentence")
    return S.sentences_per_review(d, s, key="lang")


def _z2_sql():
    return oracle(f"""
WITH d AS (SELECT doc_id, lang, text FROM documents WHERE {Q.strip("coalesce(text, '')")} <> ''),
sents AS (SELECT lang, sentence FROM (
           SELECT lang, unnest(pieces) AS sentence FROM (
             SELECT lang, {Q.split_punct('text')} AS pieces FROM d WHERE text <> 'nan'))
          WHERE {Q.words('sentence')} >= 2),
per AS (SELECT r.lang, r.reviews, coalesce(s.sentences, 0) AS sentences
        FROM (SELECT lang, count(*) AS reviews FROM d GROUP BY lang) r
        LEFT JOIN (SELECT lang, count(*) AS sentences FROM sents GROUP BY lang) s USING (lang)),
allrows AS (SELECT lang, reviews, sentences FROM per UNION ALL
            SELECT 'ALL', CAST(sum(reviews) AS BIGINT), CAST(sum(sentences) AS BIGINT) FROM per)
SELECT lang, reviews, sentences, CAST(sentences AS DOUBLE) / reviews AS sentences_per_review FROM allrows""",
                  [], doubles=("sentences_per_review",))


@register("Z3_sentiment_summaries")
def z3(spark, sf):
    """Z3 (P11 -> P2 -> F2 -> N5 -> A11 -> A27): labelled documents keep their label,
    the rest are scored; per-language summaries and the master table."""
    d = V.v_label(spark, sf).select(F.col("lang").alias("movie_name"), "text", "sentiment", "source")
    d = R.drop_empty_text(d, "text")
    scored = R.rescore_mode(d, 3, lambda x: SC.lexicon_scorer(x, "text"), label="sentiment")
    scored = scored.withColumn("rating", F.lit(None).cast("string"))
    return A.master_summary(A.movie_summary(scored, RUN_STAMP), RUN_STAMP)


def _z3_sql():
    lx = _lex_sql("text")
    scored = f"""sc AS (
  SELECT lang AS movie_name, sentiment, NULL::DOUBLE AS confidence, source FROM v_label
  WHERE {Q.strip("coalesce(text, '')")} <> '' AND sentiment IS NOT NULL
  UNION ALL
  SELECT lang, {lx['sentiment']}, {lx['confidence']}, source FROM v_label
  WHERE {Q.strip("coalesce(text, '')")} <> '' AND sentiment IS NULL),
s AS (SELECT *, {_std('sentiment')} AS sentiment_std, NULL::DOUBLE AS r FROM sc)"""
    summ = (f"SELECT movie_name AS movie, count(*) AS total_rows, " + ", ".join(_a6_cols())
            + f", {_he('avg(confidence)', 3)} AS avg_confidence, {_he('avg(r)', 2)} AS avg_rating FROM s GROUP BY movie_name")
    per = ("SELECT movie, total_rows, " + ", ".join(f"{lab}_count, {lab}_percentage" for lab in LABELS)
           + ", coalesce(avg_confidence, 0.0) AS avg_confidence, coalesce(avg_rating, 0.0) AS avg_rating, "
             f"'{RUN_STAMP}' AS analysis_date FROM summ")
    tot = ("SELECT 'All Movies', sum(total_rows), "
           + ", ".join(f"sum({lab}_count), {_he(f'avg({lab}_percentage)', 2)}" for lab in LABELS)
           + f", {_he('avg(avg_confidence)', 3)}, {_he('avg(avg_rating)', 2)}, '{RUN_STAMP}' FROM per")
    return (f"WITH {V.SQL_V_LABEL}, {scored}, summ AS ({summ}), per AS ({per})\n"
            + oracle(f"SELECT * FROM per UNION ALL SELECT * FROM ({tot})", [],
                     doubles=_D6 + ("avg_confidence", "avg_rating")))


# ---- oracles assembled from the shared pieces
from reelscope.plans.catalog import REGISTRY  # noqa: E402

REGISTRY["F2_lexicon_scorer"].sql = _f2_sql()
REGISTRY["P11_rescore_mode"].sql = _p11_sql()
REGISTRY["A2_review_vote"].sql = _a2_sql()
REGISTRY["A6_label_distribution"].sql = _with(
    "SELECT movie_name, count(*) AS total_rows, " + ", ".join(_a6_cols()) + " FROM s GROUP BY movie_name", _D6)
REGISTRY["A7_confidence_stats"].sql = _with(
    "SELECT movie_name, " + ", ".join(_a7_cols()) + " FROM s GROUP BY movie_name", _D7)
REGISTRY["A8_rating_stats"].sql = _with(
    "SELECT movie_name, " + ", ".join(_a8_cols()) + " FROM s GROUP BY movie_name", _D8)
REGISTRY["A11_movie_summary"].sql = _with(_summary_sql(), _D6 + _D7 + _D8)
REGISTRY["A27_master_summary"].sql = _a27_sql()
REGISTRY["A5_unique_reviews"].sql = _a5_sql()
REGISTRY["Z2_sentence_table"].sql = _z2_sql()
REGISTRY["Z3_sentiment_summaries"].sql = _z3_sql()
