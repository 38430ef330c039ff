"""Checked queries for the scalar functions: dates (D1-D9), text (T1-T10) and numbers,
labels and arrays (N1-N9, N15, N18-N20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions import dates as DT
from reelscope.functions import numbers as N
from reelscope.functions import text as TX
from reelscope.functions.stopwords import default_stopwords
from reelscope.operators import sentences as S
from reelscope.operators import reshape as R
from reelscope.plans import sqlfrag as Q
from reelscope.plans import views as V
from reelscope.plans.catalog import oracle, register

YEAR = 2025  # the year put into year-less dates (a parameter, never the run date)
REV = [V.SQL_V_REV]
DOC = [V.SQL_V_DOC]


# ------------------------------------------------------------------ dates

@register("D1_parse_review_date", oracle(
    f"SELECT review_id, raw_date, {Q.parse_review_date('raw_date', YEAR)} AS parsed FROM v_rev",
    REV, stamps=("parsed",)))
def d1(spark, sf):
    """The 21-format date chain on raw date texts."""
    r = V.v_rev(spark, sf)
    return r.select("review_id", "raw_date", DT.parse_review_date("raw_date", YEAR).alias("parsed"))


@register("D2_fill_missing_year", oracle(
    f"SELECT review_id, raw_date, {Q.fill_year(Q.strip('raw_date'), YEAR)} AS filled FROM v_rev",
    REV, stamps=("filled",)))
def d2(spark, sf):
    """Year-less forms parsed in a given year."""
    r = V.v_rev(spark, sf)
    return r.select("review_id", "raw_date", DT.fill_missing_year(TX.strip_ws(F.col("raw_date")), YEAR).alias("filled"))


@register("D3_is_missing_token", oracle(
    f"SELECT review_id, raw_date, {Q.missing('raw_date')} AS is_missing, "
    f"CASE WHEN {Q.missing('raw_rating')} THEN NULL ELSE {Q.strip('raw_rating')} END AS rating_text FROM v_rev",
    REV))
def d3(spark, sf):
    """D3: missing-value tokens -> null."""
    r = V.v_rev(spark, sf)
    return r.select("review_id", "raw_date", DT.is_missing_token("raw_date").alias("is_missing"),
                    DT.null_if_missing("raw_rating").alias("rating_text"))


@register("D4_parse_date_strict", oracle(
    "SELECT review_id, raw_date, try_strptime(raw_date, '%Y-%m-%d') AS parsed FROM v_rev "
    "WHERE try_strptime(raw_date, '%Y-%m-%d') IS NOT NULL", REV, stamps=("parsed",)))
def d4(spark, sf):
    """D4 + P4: one format, unparsable rows dropped."""
    r = V.v_rev(spark, sf)
    return (r.select("review_id", "raw_date", DT.parse_date_strict("raw_date", "yyyy-M-d").alias("parsed"))
             .dropna(subset=["parsed"]))


@register("D5_month_of", oracle(
    "SELECT review_id, movie_name, CAST(date_trunc('month', date) AS DATE) AS month FROM v_rev",
    REV, dates=("month",)))
def d5(spark, sf):
    """Month bucket of every review date."""
    r = V.v_rev(spark, sf)
    return r.select("review_id", "movie_name", DT.month_of("date").alias("month"))


@register("D6_month_parts", oracle(
    "SELECT DISTINCT movie_name, month, strftime(month, '%b %Y') AS month_name, strftime(month, '%b') AS month_short, "
    "year(month) AS year, month(month) AS month_num FROM (SELECT movie_name, "
    "CAST(date_trunc('month', date) AS DATE) AS month FROM v_rev WHERE date IS NOT NULL)",
    REV, dates=("month",)))
def d6(spark, sf):
    """Month name, short name, year and number of every review month."""
    r = V.v_rev(spark, sf).filter(F.col("date").isNotNull())
    months = r.select("movie_name", DT.month_of("date").alias("month")).distinct()
    return DT.month_parts(months)


@register("D8_days_since_first", oracle(
    "SELECT review_id, movie_name, date, CAST(floor((epoch(date) - epoch(min(date) OVER (PARTITION BY movie_name)))"
    " / 86400) AS BIGINT) AS days_since_first FROM v_rev", REV, stamps=("date",)))
def d8(spark, sf):
    """Whole days since the movie's first review."""
    r = V.v_rev(spark, sf).select("review_id", "movie_name", "date")
    return DT.days_since_first(r, "movie_name")


@register("D9_review_days", oracle(
    "SELECT DISTINCT movie_name, strftime(CAST(date AS DATE), '%Y-%m-%d') AS review_day FROM v_rev "
    "WHERE date IS NOT NULL", REV))
def d9(spark, sf):
    """Distinct calendar days with a review, per movie."""
    return DT.review_days(V.v_rev(spark, sf), "movie_name")


# ------------------------------------------------------------------ text

@register("T1_strip_emojis", oracle(
    f"SELECT doc_id, regexp_replace(text, '{Q.EMOJI}', '', 'g') AS text_clean FROM v_doc", DOC))
def t1(spark, sf):
    """Emoji runs removed from whole documents."""
    return V.v_doc(spark, sf).select("doc_id", TX.strip_emojis("text").alias("text_clean"))


@register("T2_title_plus_text", oracle(
    "SELECT conv_id, turn, CASE WHEN role IS NOT NULL AND role <> '' AND text IS NOT NULL AND text <> '' "
    "THEN role || ': ' || text WHEN text IS NOT NULL AND text <> '' THEN text ELSE '' END AS review_text "
    "FROM v_turn", [V.SQL_V_TURN]))
def t2(spark, sf):
    """Title and text combined (role as the title)."""
    t = V.v_turn(spark, sf)
    return t.select("conv_id", "turn", TX.title_plus_text("role", "text").alias("review_text"))


@register("T3_slug", oracle(
    "SELECT page_id, regexp_replace(replace(replace(lower(url), ' ', '_'), 'ñ', 'n'), '!', '', 'g') AS slug, "
    "regexp_replace(replace(replace(lower(url), ' ', '_'), 'ñ', 'n'), '[!.]', '', 'g') AS slug_nodots "
    "FROM v_page", [V.SQL_V_PAGE]))
def t3(spark, sf):
    """File-name slugs."""
    p = V.v_page(spark, sf)
    return p.select("page_id", TX.slug("url").alias("slug"), TX.slug("url", drop_dots=True).alias("slug_nodots"))


@register("T4_split_sentences_punct", oracle(
    f"""SELECT doc_id, lang, sentence_num, sentence FROM (
          SELECT doc_id, lang, unnest(pieces) AS sentence, CAST(generate_subscripts(pieces, 1) AS BIGINT) AS sentence_num
          FROM (SELECT doc_id, lang, {Q.split_punct('text')} AS pieces FROM v_doc
                WHERE text IS NOT NULL AND text <> '' AND text <> 'nan'))
        WHERE {Q.words('sentence')} >= 2""", DOC))
def t4(spark, sf):
    """T4: punctuation splitter, numbered from 1 before short pieces are dropped."""
    return S.split_sentences_punct(V.v_doc(spark, sf).select("doc_id", "lang", "text"), text="text", out="sentence")


@register("T5_split_sentences_boundary", oracle(
    f"""SELECT doc_id, lang, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS sentence_index,
               unnest(pieces) AS sentence_text
        FROM (SELECT doc_id, lang, {Q.split_boundary('text')} AS pieces FROM v_doc)""", DOC))
def t5(spark, sf):
    """T5: boundary splitter, numbered from 0 after filtering."""
    return S.split_sentences_boundary(V.v_doc(spark, sf).select("doc_id", "lang", "text"), text="text")


@register("T6_explode_with_placeholder", oracle(
    f"""SELECT doc_id, CAST(len(pieces) AS BIGINT) AS sentence_count,
               CASE WHEN len(pieces) = 0 THEN 'neutral' END AS placeholder_label,
               CASE WHEN len(pieces) = 0 THEN 0.0 END AS placeholder_score
        FROM (SELECT doc_id, {Q.split_boundary('text')} AS pieces FROM v_doc)""", DOC,
    doubles=("placeholder_score",)))
def t6(spark, sf):
    """Texts without sentences stay as one placeholder row (count 0, neutral, 0.0)."""
    s = S.split_sentences_boundary(V.v_doc(spark, sf).select("doc_id", "text"), text="text", keep_empty=True)
    agg = s.groupBy("doc_id").agg(F.count("sentence_index").alias("sentence_count"))
    empty = F.col("sentence_count") == 0
    return agg.select("doc_id", "sentence_count",
                      F.when(empty, F.lit("neutral")).alias("placeholder_label"),
                      F.when(empty, F.lit(0.0)).alias("placeholder_score"))


@register("T7_preview", oracle(
    "SELECT lang, CASE WHEN length(t) > 30 THEN substr(t, 1, 27) || '...' ELSE t END AS sample FROM ("
    "SELECT lang, arg_min(text, doc_id) FILTER (WHERE text IS NOT NULL) AS t FROM v_doc GROUP BY lang)", DOC))
def t7(spark, sf):
    """First non-null text per language (by id), cut to 30 characters."""
    d = V.v_doc(spark, sf)
    first = d.groupBy("lang").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.col("doc_id"))).alias("t"))
    return first.select("lang", TX.preview("t").alias("sample"))


@register("T8_keyword_string", oracle(
    f"SELECT doc_id, array_to_string({Q.tokens('text')}, ', ') AS keyword_string, "
    f"substr(array_to_string({Q.tokens('text')}, ', '), 1, 60) AS keyword_label FROM v_doc", DOC))
def t8(spark, sf):
    """All tokens of a text joined, and the label of 60 characters."""
    d = V.v_doc(spark, sf).select("doc_id", TX.tokens("text").alias("t"))
    return d.select("doc_id", TX.keyword_string("t").alias("keyword_string"),
                    TX.keyword_string("t", 60).alias("keyword_label"))


@register("T9_tokenize_ngrams", oracle(
    f"SELECT doc_id, CAST(generate_subscripts(g, 1) - 1 AS BIGINT) AS position, unnest(g) AS term "
    f"FROM (SELECT doc_id, {Q.ngrams_of('k')} AS g FROM "
    f"(SELECT doc_id, {Q.kept_tokens('text', default_stopwords())} AS k FROM v_doc))", DOC))
def t9(spark, sf):
    """Stop words removed, then every uni- and bigram of the whole text with its position."""
    d = TX.with_ngrams(V.v_doc(spark, sf).select("doc_id", "text"), "text", default_stopwords(), out="g")
    return R.explode_list(d, F.col("g"), ["doc_id"], "term", "position").withColumn("position", F.col("position").cast("long"))


@register("T10_format_pct", oracle(
    f"SELECT review_id, printf('%.1f%%', {Q.half_even('rating', 1)}) AS rating_text FROM v_rev WHERE rating IS NOT NULL",
    REV))
def t10(spark, sf):
    """Percentages as ``12.3%`` text."""
    r = V.v_rev(spark, sf).filter(F.col("rating").isNotNull())
    return r.select("review_id", TX.format_pct(N.round_half_even(F.col("rating"), 1)).alias("rating_text"))


# ------------------------------------------------------------------ numbers and labels

def _sql_ratio(e: str) -> str:
    parts = f"string_split({e}, '/')"
    num, den = Q.to_double(f"{parts}[1]"), Q.to_double(f"{parts}[2]")
    return f"(CASE WHEN len({parts}) = 2 THEN {num} / nullif({den}, 0) * 100.0 END)"


def _sql_imdb(e):
    s = Q.strip(e)
    return f"(CASE WHEN {s} LIKE '%/%' THEN {_sql_ratio(s)} ELSE {Q.to_double(s)} / 10.0 * 100.0 END)"


def _sql_ltbx(e):
    return f"({Q.to_double(e)} / 10.0 * 100.0)"


def _sql_rt(e):
    s = Q.strip(e)
    return (f"(CASE WHEN {s} LIKE '%/%' THEN {_sql_ratio(s)} WHEN lower({s}) = 'fresh' THEN 100.0 "
            f"WHEN lower({s}) = 'rotten' THEN 0.0 WHEN lower({s}) = 'no score' OR {s} = '' THEN NULL "
            f"ELSE {Q.to_double(s)} END)")


@register("N1_N3_rating_scale", oracle(
    f"SELECT review_id, source, raw_rating, {_sql_imdb('raw_rating')} AS imdb_pct, {_sql_ltbx('raw_rating')} AS ltbx_pct, "
    f"{_sql_rt('raw_rating')} AS rt_pct, CASE source WHEN 'imdb' THEN {_sql_imdb('raw_rating')} "
    f"WHEN 'ltbx' THEN {_sql_ltbx('raw_rating')} WHEN 'rt' THEN {_sql_rt('raw_rating')} END AS rating_pct FROM v_rev",
    REV, doubles=("imdb_pct", "ltbx_pct", "rt_pct", "rating_pct")))
def n1_n3(spark, sf):
    """The three sites' rating texts on one 0-100 scale."""
    r = V.v_rev(spark, sf)
    return r.select("review_id", "source", "raw_rating",
                    N.rating_pct_imdb("raw_rating").alias("imdb_pct"),
                    N.rating_pct_ltbx("raw_rating").alias("ltbx_pct"),
                    N.rating_pct_rt("raw_rating").alias("rt_pct"),
                    N.rating_pct("raw_rating", "source").alias("rating_pct"))


def _sql_clip(e):
    x = Q.to_double(e)
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(100.0, {x})) END)"


@register("N4_clip_0_100", oracle(
    f"SELECT review_id, {_sql_clip('raw_rating')} AS clipped_text, {_sql_clip('rating * 1.5 - 20.0')} AS clipped "
    f"FROM v_rev", REV, doubles=("clipped_text", "clipped")))
def n4(spark, sf):
    """To number and clipped to 0..100; nulls stay null."""
    r = V.v_rev(spark, sf)
    return r.select("review_id", N.clip_0_100("raw_rating").alias("clipped_text"),
                    N.clip_0_100(F.col("rating") * 1.5 - 20.0).alias("clipped"))


def _label_candidates_spark(e):
    k = F.col("event_id")
    return [F.col("event_type"), F.col("props"),
            F.when(k % 13 != 0, F.concat(F.lit("0."), (k % 10).cast("string"))),
            F.concat(F.lit("."), (k % 10).cast("string")),
            F.concat(F.lit("LABEL_"), (k % 4).cast("string"))]


_LABEL_SQL = ["event_type", "props", "CASE WHEN event_id % 13 <> 0 THEN '0.' || CAST(event_id % 10 AS VARCHAR) END",
              "'.' || CAST(event_id % 10 AS VARCHAR)", "'LABEL_' || CAST(event_id % 4 AS VARCHAR)"]


def _sql_label(e: str, full: bool) -> str:
    s = f"lower(CAST({e} AS VARCHAR))"
    rule = (f"WHEN contains({s}, 'pos') OR contains({s}, '2') THEN 'positive' "
            f"WHEN contains({s}, 'neg') OR contains({s}, '0') THEN 'negative' "
            f"WHEN contains({s}, 'neu') OR contains({s}, '1') THEN 'neutral' ")
    if full:
        x = Q.to_double(s)
        rule += (f"WHEN {x} >= 0.6 THEN 'positive' WHEN {x} <= 0.4 THEN 'negative' WHEN {x} IS NOT NULL THEN 'neutral' "
                 f"WHEN lower({Q.strip(s)}) = 'nan' THEN 'neutral' ")
        return f"(CASE WHEN {e} IS NULL THEN 'neutral' ELSE (CASE {rule} ELSE {s} END) END)"
    return f"(CASE {rule} ELSE {s} END)"


@register("N5_N6_standardize_label", oracle(
    "SELECT event_id, " + ", ".join(
        f"{_sql_label(e, True)} AS std_{i}, {_sql_label(e, False)} AS basic_{i}" for i, e in enumerate(_LABEL_SQL))
    + " FROM events", []))
def n5_n6(spark, sf):
    """N5 + N6: free-form labels onto positive / negative / neutral."""
    e = V.table(spark, sf, "events")
    cols = []
    for i, c in enumerate(_label_candidates_spark(e)):
        cols += [N.standardize_label(c).alias(f"std_{i}"), N.standardize_label_basic(c).alias(f"basic_{i}")]
    return e.select("event_id", *cols)


# Every component of a vector is a logit here; class i is called by i modulo 3.
ID2LABEL = {f"LABEL_{i}": ("NEG", "NEU", "POS")[i % 3] for i in range(64)}


@register("N7_N9_model_output", oracle(
    """SELECT vec_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS class, unnest(p) AS probability,
              CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS pred_idx, list_max(p) AS confidence,
              CASE (list_position(p, list_max(p)) - 1) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral'
                   WHEN 2 THEN 'positive' END AS sentiment
       FROM (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
             SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM (
             SELECT vec_id, CAST(embedding AS DOUBLE[]) AS l FROM embeddings)))""",
    [], doubles=("probability", "confidence")))
def n7_n9(spark, sf):
    """Softmax of whole logit vectors, argmax with first-on-ties, label from the index; a row per class."""
    p = V.table(spark, sf, "embeddings").select("vec_id", N.softmax("embedding").alias("p"))
    idx = N.argmax_index(F.col("p"))
    out = p.select("vec_id", "p", idx.alias("pred_idx"), F.array_max("p").alias("confidence"),
                   N.map_model_label(idx, ID2LABEL).alias("sentiment"))
    return R.explode_list(out, F.col("p"), ["vec_id", "pred_idx", "confidence", "sentiment"], "probability", "class")


@register("N18_dominant_sentiment", oracle(
    """SELECT movie_name, review_index, pos_pct, neg_pct, neu_pct,
              CASE WHEN pos_pct > 50 THEN 'POSITIVE' WHEN neg_pct > 50 THEN 'NEGATIVE' WHEN neu_pct > 50 THEN 'NEUTRAL'
                   WHEN pos_pct >= neg_pct AND pos_pct >= neu_pct THEN 'MOSTLY_POSITIVE'
                   WHEN neg_pct >= pos_pct AND neg_pct >= neu_pct THEN 'MOSTLY_NEGATIVE' ELSE 'MIXED' END AS dominant
       FROM (SELECT movie_name, review_index,
                    count(*) FILTER (WHERE sentiment_label = 'positive') / count(*) * 100.0 AS pos_pct,
                    count(*) FILTER (WHERE sentiment_label = 'negative') / count(*) * 100.0 AS neg_pct,
                    count(*) FILTER (WHERE sentiment_label = 'neutral') / count(*) * 100.0 AS neu_pct
             FROM v_sent GROUP BY movie_name, review_index)""",
    [V.SQL_V_SENT], doubles=("pos_pct", "neg_pct", "neu_pct")))
def n18(spark, sf):
    """Dominant class of a group from its three shares."""
    s = V.v_sent(spark, sf)
    n = F.count(F.lit(1))
    g = s.groupBy("movie_name", "review_index").agg(
        *[(F.count_if(F.col("sentiment_label") == lab) / n * 100.0).alias(f"{p}_pct")
          for lab, p in [("positive", "pos"), ("negative", "neg"), ("neutral", "neu")]])
    return g.withColumn("dominant", N.dominant_sentiment("pos_pct", "neg_pct", "neu_pct"))


@register("N19_topic_params", oracle(
    """SELECT lang, n_docs, min_topic_size, CAST(least(greatest(1, floor(n_docs * 0.001)), greatest(1, floor(min_topic_size * 0.5))) AS BIGINT) AS min_df,
              CAST(greatest(least(greatest(1, floor(n_docs * 0.001)), greatest(1, floor(min_topic_size * 0.5))) + 1, floor(n_docs * 0.8)) AS BIGINT) AS max_df
       FROM (SELECT lang, count(*) AS n_docs,
                    CAST(CASE WHEN count(*) < 200 THEN 3 WHEN count(*) < 1000 THEN 10 ELSE 20 END AS BIGINT) AS min_topic_size
             FROM v_doc GROUP BY lang)""", DOC))
def n19(spark, sf):
    """Topic-model parameters from the number of documents per group."""
    g = V.v_doc(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    return g.withColumns(N.topic_params("n_docs"))


@register("N20_score_bin", oracle(
    """SELECT movie_name, review_index, sentence_index,
              CAST(least(greatest(floor((sentiment_score - 0.0) / CAST(0.03333333333333333 AS DOUBLE)) + 1, 1), 30) AS BIGINT) AS score_bin
       FROM v_sent""", [V.SQL_V_SENT]))
def n20(spark, sf):
    """30 equal-width bins of the sentence score."""
    s = V.v_sent(spark, sf)
    return s.select("movie_name", "review_index", "sentence_index", N.score_bin("sentiment_score").alias("score_bin"))
