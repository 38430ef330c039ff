"""Checked queries for topic work (M1-M9, A28-A32, O4, W6, Z4). Topics come ready from the
embedding labels (``v_topic``); M1 and M2 are checked by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelscope.functions.stopwords import default_stopwords
from reelscope.operators import scoring as SC
from reelscope.operators import sentences as S
from reelscope.operators import topics as M
from reelscope.operators.density import density_topics
from reelscope.plans import sqlfrag as Q
from reelscope.plans import views as V
from reelscope.plans.catalog import REGISTRY, oracle, register
from reelscope.plans.cases_sentiment import _lex_sql

KEYS = ["movie_name"]
RUN_STAMP = "2025-12-18 14:11:13"
LABELS = ["positive", "negative", "neutral"]


# ------------------------------------------------------------------ shared Spark pieces

def _votes(spark, sf, *carried):
    """One row per document with its topic and its vote (A2, M9); the texts are split and scored once."""
    keys = ["doc_id", "movie_name", "topic", *carried]
    t = V.v_topic(spark, sf).withColumn("_text", F.col("review_text"))
    s = S.split_sentences_boundary(t.select(*keys, "_text"), text="_text", keep_empty=True)
    s = SC.lexicon_scorer(s, "sentence_text").withColumnsRenamed(
        {"sentiment": "sentiment_label", "confidence": "sentiment_score"})
    return S.review_vote(s.select(*keys, "sentence_index", "sentiment_label", "sentiment_score"), keys, global_index=None)


def _reviews(spark, sf):
    """Texts with their topic and vote label, for M7."""
    t = V.v_topic(spark, sf)
    return M.topic_assignments(t.drop("topic"), _votes(spark, sf).drop("movie_name"), t, "doc_id")


def _levels(spark, sf):
    return M.topic_levels(_votes(spark, sf), KEYS)


def _terms(spark, sf, keys=KEYS, df=None):
    src = df if df is not None else V.v_topic(spark, sf)
    return M.topic_terms(src, "review_text", keys, default_stopwords())


# ------------------------------------------------------------------ shared SQL pieces

def _vote_ctes() -> str:
    lx = _lex_sql("sentence_text")
    return f"""
dv_pieces AS (SELECT doc_id, movie_name, {Q.split_boundary('review_text')} AS pieces FROM v_topic),
dv_sents AS (SELECT doc_id, movie_name, CAST(generate_subscripts(pieces, 1) - 1 AS BIGINT) AS sentence_index,
                    unnest(pieces) AS sentence_text FROM dv_pieces),
dv_scored AS (SELECT doc_id, movie_name, sentence_index, {lx['sentiment']} AS sentiment_label,
                     {lx['confidence']} AS sentiment_score FROM dv_sents),
dv_per AS (SELECT doc_id, sentiment_label, count(*) AS n, min(sentence_index) AS first FROM dv_scored
           GROUP BY doc_id, sentiment_label),
dv_vote AS (SELECT doc_id, sentiment_label FROM (
              SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM dv_per) WHERE rn = 1),
dv_stats AS (SELECT doc_id, avg(sentiment_score) AS sentiment_score, count(*) AS sentence_count
             FROM dv_scored GROUP BY doc_id),
doc_votes AS (SELECT v.doc_id, v.sentiment_label, s.sentiment_score, s.sentence_count
              FROM dv_vote v JOIN dv_stats s USING (doc_id)
              UNION ALL SELECT doc_id, 'neutral', 0.0, 0 FROM dv_pieces WHERE len(pieces) = 0),
reviews AS (SELECT t.doc_id, t.movie_name, t.review_text, t.topic, v.sentiment_label, v.sentiment_score
            FROM v_topic t LEFT JOIN doc_votes v USING (doc_id))"""


def _term_ctes(keys: str = "movie_name", src: str = "v_topic") -> str:
    k = Q.kept_tokens("review_text", default_stopwords())
    return f"""
tm_kt AS (SELECT {keys}, topic, {k} AS k FROM {src}),
tm_grams AS (SELECT {keys}, topic, unnest({Q.ngrams_of('k')}) AS term FROM tm_kt),
terms AS (SELECT {keys}, topic, term, count(*) AS n FROM tm_grams GROUP BY ALL)"""


def _kw_ctes(k: int, keys: str = "movie_name", name: str = "kw") -> str:
    return f""",
{name}_z AS (SELECT {keys}, topic, sum(n) AS z FROM terms GROUP BY ALL),
{name}_a AS (SELECT {keys}, avg(z) AS a FROM {name}_z GROUP BY ALL),
{name}_f AS (SELECT {keys}, term, sum(n) AS f FROM terms GROUP BY ALL),
{name}_s AS (SELECT t.*, round(n / z * ln(1 + a / f) * 1e6) / 1e6 AS score
             FROM terms t JOIN {name}_z USING ({keys}, topic) JOIN {name}_a USING ({keys}) JOIN {name}_f USING ({keys}, term)),
{name} AS (SELECT {keys}, topic, term AS keyword, score, rank FROM (
             SELECT *, row_number() OVER (PARTITION BY {keys}, topic ORDER BY score DESC, term) AS rank FROM {name}_s)
           WHERE rank <= {k})"""


def _topic_sql(body: str, ctes: str, doubles=(), stamps=()) -> str:
    inner = oracle("SELECT * FROM out_q", [], doubles=doubles, stamps=stamps)
    return "WITH " + V.SQL_V_TOPIC + "," + ctes + f", out_q AS ({body})\n" + inner


def _he(e, d):
    return Q.half_even(e, d)


# ------------------------------------------------------------------ M1, M2

@register("M1_embed", oracle(f"""
WITH t AS (SELECT doc_id, unnest({Q.tokens('text')}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
d AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) AS idf FROM c GROUP BY term),
w AS (SELECT doc_id, term, n * idf AS w FROM c JOIN d USING (term) WHERE idf > 0)
SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w""", [], doubles=("weight",)))
def m1(spark, sf):
    """M1: TF-IDF weights of every term of every document, true vocabulary, unit length."""
    return M.tfidf_weights(V.v_doc(spark, sf).select("doc_id", "text"), "doc_id", "text")


M2_SIMILARITY, M2_POINTS = 0.3, 5


@register("M2_assign_topics", oracle(f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON len(a.v) = len(b.v)),
near AS (SELECT * FROM s WHERE sim >= {M2_SIMILARITY} OR a = b),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {M2_POINTS}),
link AS (SELECT a, b FROM near SEMI JOIN core x ON x.id = a SEMI JOIN core y ON y.id = b),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
edge AS (SELECT a AS id, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS k
  FROM near SEMI JOIN core ON core.id = b ANTI JOIN core c ON c.id = a) WHERE k = 1)
SELECT vec_id, CAST(coalesce(root.root, far.root, -1) AS BIGINT) AS topic, root.id IS NOT NULL AS is_core
FROM e LEFT JOIN root ON root.id = vec_id LEFT JOIN edge ON edge.id = vec_id LEFT JOIN root far ON far.id = edge.b""", []))
def m2(spark, sf):
    """M2: density topics of the embedding vectors, noise -1."""
    return density_topics(V.v_emb(spark, sf), "vec_id", "embedding", M2_SIMILARITY, M2_POINTS)


@register("M2_assign_to_centres")
def m2c(spark, sf):
    """M2 (fixed centres): nearest label centroid by cosine, the smallest topic on ties."""
    e = V.v_emb(spark, sf)
    return M.assign_to_centres(e, M.topic_centres(e), "vec_id")


REGISTRY["M2_assign_to_centres"].sql = oracle("""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                  CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS topic FROM embeddings),
cells AS (SELECT topic, i, avg(x) AS m FROM (SELECT topic, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM e
                                             WHERE topic <> -1) GROUP BY topic, i),
cen AS (SELECT topic, list(m ORDER BY i) AS c FROM cells GROUP BY topic),
sims AS (SELECT e.vec_id, cen.topic,
                list_sum(list_transform(range(1, len(e.v) + 1), lambda j: e.v[j] * cen.c[j]))
                  / (sqrt(list_sum(list_transform(e.v, lambda x: x * x))) * sqrt(list_sum(list_transform(cen.c, lambda x: x * x))))
                  AS sim
         FROM e, cen)
SELECT vec_id, CAST(topic AS BIGINT) AS topic FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic) AS rn FROM sims) WHERE rn = 1""", [])


# ------------------------------------------------------------------ M3 - M9

@register("M3_rank_topics", _topic_sql("""
SELECT t.doc_id, t.movie_name, t.topic AS old_topic, CAST(coalesce(r.new_topic, -1) AS BIGINT) AS topic
FROM v_topic t LEFT JOIN (
  SELECT movie_name, topic, row_number() OVER (PARTITION BY movie_name ORDER BY n DESC, topic) - 1 AS new_topic
  FROM (SELECT movie_name, topic, count(*) AS n FROM v_topic WHERE topic <> -1 GROUP BY ALL)) r
USING (movie_name, topic)""", " x AS (SELECT 1)"))
def m3(spark, sf):
    """M3: topics renumbered by size within each movie, -1 kept."""
    t = V.v_topic(spark, sf).select("doc_id", "movie_name", "topic").withColumn("old_topic", F.col("topic"))
    return M.rank_topics(t, KEYS).select("doc_id", "movie_name", "old_topic", "topic")


@register("M4_topic_terms", _topic_sql("SELECT movie_name, topic, term, n FROM terms", _term_ctes()))
def m4(spark, sf):
    """M4: n-gram counts per (movie, topic, term), every term kept."""
    return _terms(spark, sf)


@register("M5_topic_keywords", _topic_sql("SELECT * FROM kw", _term_ctes() + _kw_ctes(5), doubles=("score",)))
def m5(spark, sf):
    """M5: class-based TF-IDF top-5 keywords per topic."""
    return M.topic_keywords(_terms(spark, sf), KEYS, 5)


@register("M6_keyword_frequencies", _topic_sql("""
SELECT k.movie_name, k.topic, k.keyword, k.score, k.rank, CAST(coalesce(c.n, 0) AS BIGINT) AS keyword_frequency
FROM kw k LEFT JOIN (
  SELECT movie_name, topic, g AS keyword, count(*) AS n FROM (
    SELECT movie_name, topic, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS g
    FROM (SELECT movie_name, topic, """ + Q.tokens("review_text") + """ AS t FROM v_topic))
  GROUP BY ALL) c USING (movie_name, topic, keyword)""", _term_ctes() + _kw_ctes(10), doubles=("score",)))
def m6(spark, sf):
    """M6: top-10 keywords with their raw occurrence count in the topic's texts."""
    return M.keyword_frequencies(V.v_topic(spark, sf), "review_text", KEYS, default_stopwords(), 10)


@register("M7_topics_by_sentiment")
def m7(spark, sf):
    """M7: keywords of positive and negative texts kept apart (the label joins the key)."""
    r = _reviews(spark, sf)
    keys = ["movie_name", "sentiment_label"]
    return M.topic_keywords(_terms(spark, sf, keys, df=r), keys, 5)


REGISTRY["M7_topics_by_sentiment"].sql = (
    "WITH " + V.SQL_V_TOPIC + "," + _vote_ctes() + ","
    + _term_ctes("movie_name, sentiment_label", "reviews") + _kw_ctes(5, "movie_name, sentiment_label")
    + "\n" + oracle("SELECT * FROM kw", [], doubles=("score",)))


@register("M8_topics_over_time", oracle("""
SELECT movie_name, sentence_text AS topic, time_bin, count(*) AS frequency, min(ts) AS first_stamp FROM (
  SELECT *, CAST(least(CASE WHEN (hi - lo) / 20.0 = 0 THEN 0 ELSE floor((us - lo) / ((hi - lo) / 20.0)) END, 19) AS BIGINT)
              AS time_bin
  FROM (SELECT *, CAST(epoch_us(ts) AS DOUBLE) AS us,
               CAST(min(epoch_us(ts)) OVER (PARTITION BY movie_name) AS DOUBLE) AS lo,
               CAST(max(epoch_us(ts)) OVER (PARTITION BY movie_name) AS DOUBLE) AS hi FROM v_sent))
GROUP BY ALL""", [V.SQL_V_SENT], stamps=("first_stamp",)))
def m8(spark, sf):
    """M8: frequency per (movie, topic, 20 equal time bins); the event type plays the topic."""
    s = V.v_sent(spark, sf).select("movie_name", F.col("sentence_text").alias("topic"), "ts")
    return M.topics_over_time(s, KEYS, "ts", 20)


DAYS = 1000


@register("M8_topic_words_over_time", _topic_sql("""
SELECT movie_name, topic, time_bin, term, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY movie_name, topic, time_bin ORDER BY score DESC, term) AS rank FROM (
    SELECT s.movie_name, s.topic, s.time_bin, s.term, round((s.s + t.n / z.z) / 2 * ln(1 + a.a / f.f) * 1e6) / 1e6 AS score
    FROM smooth s JOIN whole t USING (movie_name, topic, term) JOIN zs z USING (movie_name, topic)
    JOIN za a USING (movie_name) JOIN fs f USING (movie_name, term)))
WHERE rank <= 5""", f"""
stamped AS (SELECT *, CAST(doc_id * 7919 % {DAYS} AS DOUBLE) AS d FROM v_topic),
ranged AS (SELECT *, min(d) OVER (PARTITION BY movie_name) AS lo, max(d) OVER (PARTITION BY movie_name) AS hi FROM stamped),
binned AS (SELECT movie_name, topic, review_text, CAST(least(CASE WHEN hi = lo THEN 0
             ELSE floor((d - lo) * 86400e6 / ((hi - lo) * 86400e6 / 20.0)) END, 19) AS BIGINT) AS time_bin FROM ranged),"""
    + _term_ctes("movie_name, time_bin", "binned") + """,
whole AS (SELECT movie_name, topic, term, sum(n) AS n FROM terms GROUP BY ALL),
fs AS (SELECT movie_name, term, sum(n) AS f FROM whole GROUP BY ALL),
zs AS (SELECT movie_name, topic, sum(n) AS z FROM whole GROUP BY ALL),
za AS (SELECT movie_name, avg(z) AS a FROM zs GROUP BY ALL),
zb AS (SELECT movie_name, topic, time_bin, sum(n) AS z FROM terms GROUP BY ALL),
runs AS (SELECT *, min(time_bin) OVER (PARTITION BY movie_name, topic, run) AS start FROM (
  SELECT *, time_bin - row_number() OVER (PARTITION BY movie_name, topic ORDER BY time_bin) AS run FROM zb)),
smooth AS (SELECT t.movie_name, t.topic, later.time_bin, t.term,
             sum(t.n / own.z * pow(0.5, later.time_bin - own.time_bin + CASE WHEN own.time_bin = own.start THEN 0 ELSE 1 END)) AS s
           FROM terms t JOIN runs own USING (movie_name, topic, time_bin)
           JOIN runs later ON later.movie_name = own.movie_name AND later.topic = own.topic AND later.run = own.run
                AND later.time_bin >= own.time_bin
           GROUP BY ALL)""", doubles=("score",)))
def m8_words(spark, sf):
    """M8: the five words of every topic in each of 20 time bins, drawn towards the bin before and the whole topic; a
    document's day is made from its id."""
    t = V.v_topic(spark, sf)
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") * 7919 % DAYS).cast("int"))
    return M.topic_words_over_time(t.withColumn("ts", day), "review_text", KEYS, "ts", default_stopwords())


@register("M9_topic_assignments")
def m9(spark, sf):
    """M9: review rows with vote label, vote score and topic."""
    return _votes(spark, sf).select("doc_id", "movie_name", "sentiment_label", "sentiment_score", "topic")


REGISTRY["M9_topic_assignments"].sql = (
    "WITH " + V.SQL_V_TOPIC + "," + _vote_ctes() + "\n"
    + oracle("SELECT doc_id, movie_name, sentiment_label, sentiment_score, topic FROM reviews", [],
             doubles=("sentiment_score",)))


# ------------------------------------------------------------------ A28 - A32, O4, Z4

def _a28_spark(spark, sf):
    return M.topic_sentiment(_levels(spark, sf), KEYS, M.topic_keywords(_terms(spark, sf), KEYS, 5))


def _a28_sql_body() -> str:
    cols = []
    for lab in LABELS:
        c = f"count(*) FILTER (WHERE sentiment_label = '{lab}')"
        cols += [f"{c} AS {lab}_count", f"{_he(f'{c} / count(*) * 100.0', 2)} AS {lab}_percentage"]
    return f"""
a28_g AS (SELECT movie_name, topic, count(*) AS topic_size, {', '.join(cols)},
                 {_he('avg(sentiment_score)', 3)} AS avg_sentiment_score
          FROM reviews WHERE topic <> -1 GROUP BY movie_name, topic HAVING count(*) >= 2),
a28_kw AS (SELECT movie_name, topic, string_agg(keyword, ', ' ORDER BY rank) AS keyword_string FROM kw GROUP BY ALL),
a28 AS (SELECT g.*, CASE WHEN positive_percentage > 50 THEN 'POSITIVE' WHEN negative_percentage > 50 THEN 'NEGATIVE'
                    WHEN neutral_percentage > 50 THEN 'NEUTRAL'
                    WHEN positive_percentage >= negative_percentage AND positive_percentage >= neutral_percentage THEN 'MOSTLY_POSITIVE'
                    WHEN negative_percentage >= positive_percentage AND negative_percentage >= neutral_percentage THEN 'MOSTLY_NEGATIVE'
                    ELSE 'MIXED' END AS dominant_sentiment, k.keyword_string
        FROM a28_g g LEFT JOIN a28_kw k USING (movie_name, topic))"""


def _topics_sql(body: str, doubles=()) -> str:
    ctes = _vote_ctes() + "," + _term_ctes() + _kw_ctes(5) + "," + _a28_sql_body() + "," + _a29_a30_ctes()
    return _topic_sql(body, ctes, doubles=doubles)


def _a29_a30_ctes() -> str:
    classes = ", ".join(f"count(*) FILTER (WHERE dominant_sentiment = '{c}') AS {c}" for c in M.DOMINANT_CLASSES)
    lvl = []
    for prefix, src in (("reviews", "reviews"), ("sentences", "dv_scored_real")):
        cols = [f"count(*) AS total_{prefix}"]
        for lab in LABELS:
            c = f"count(*) FILTER (WHERE sentiment_label = '{lab}')"
            cols += [f"{c} AS {prefix}_{lab}", f"{_he(f'{c} / count(*) * 100.0', 2)} AS {prefix}_{lab}_percentage"]
        lvl.append(f"lvl_{prefix} AS (SELECT movie_name, {', '.join(cols)} FROM {src} GROUP BY movie_name)")
    return f"""
a29 AS (SELECT t.movie_name, t.total_topics, {', '.join(f'coalesce(d.{c}, 0) AS {c}' for c in M.DOMINANT_CLASSES)}
        FROM (SELECT movie_name, count(DISTINCT topic) AS total_topics FROM reviews WHERE topic <> -1 GROUP BY ALL) t
        LEFT JOIN (SELECT movie_name, {classes} FROM a28 GROUP BY movie_name) d USING (movie_name)),
dv_scored_real AS (SELECT * FROM dv_scored),
{lvl[0]},
{lvl[1]},
a30 AS (SELECT r.movie_name, r.total_reviews, coalesce(s.total_sentences, 0) AS total_sentences,
               {', '.join(f'coalesce(r.reviews_{lab}, 0) AS reviews_{lab}, coalesce(r.reviews_{lab}_percentage, 0.0) AS reviews_{lab}_percentage' for lab in LABELS)},
               {', '.join(f'coalesce(s.sentences_{lab}, 0) AS sentences_{lab}, coalesce(s.sentences_{lab}_percentage, 0.0) AS sentences_{lab}_percentage' for lab in LABELS)},
               coalesce(a.total_topics, 0) AS total_topics,
               {', '.join(f'coalesce(a.{c}, 0) AS {c}' for c in M.DOMINANT_CLASSES)}
        FROM lvl_reviews r LEFT JOIN lvl_sentences s USING (movie_name) LEFT JOIN a29 a USING (movie_name))"""


A28_COLS = ["movie_name", "topic", "topic_size", "positive_count", "positive_percentage", "negative_count",
            "negative_percentage", "neutral_count", "neutral_percentage", "avg_sentiment_score",
            "dominant_sentiment", "keyword_string"]
_A28_D = ("positive_percentage", "negative_percentage", "neutral_percentage", "avg_sentiment_score")


@register("A28_topic_sentiment", _topics_sql("SELECT " + ", ".join(A28_COLS) + " FROM a28", doubles=_A28_D))
def a28(spark, sf):
    """A28 (+ N18, M5): per topic size, label counts and %, dominant class, mean score, keywords."""
    return _a28_spark(spark, sf).select(*A28_COLS)


@register("A29_topic_sentiment_distribution", _topics_sql("SELECT * FROM a29"))
def a29(spark, sf):
    """Topics per dominant class and topics found, per movie."""
    return M.topic_sentiment_distribution(_levels(spark, sf), KEYS)


def _a30_spark(spark, sf):
    return M.movie_topic_stats(_levels(spark, sf), KEYS, RUN_STAMP)


def _flat_a30(df):
    cols = ["movie_name", "total_reviews", "total_sentences"]
    for prefix, field in (("reviews", "review_level_sentiment"), ("sentences", "sentence_level_sentiment")):
        for lab in LABELS:
            cols += [F.col(f"{field}.{lab}").alias(f"{prefix}_{lab}"),
                     F.col(f"{field}.{lab}_percentage").alias(f"{prefix}_{lab}_percentage")]
    cols += ["total_topics"] + [F.col(f"topic_sentiment_distribution.{c}").alias(c) for c in M.DOMINANT_CLASSES]
    return df.select(*cols)


_A30_D = tuple(f"{p}_{lab}_percentage" for p in ("reviews", "sentences") for lab in LABELS)


@register("A30_movie_topic_stats", _topics_sql("SELECT * FROM a30", doubles=_A30_D))
def a30(spark, sf):
    """The nested per-movie record, shown flat."""
    return _flat_a30(_a30_spark(spark, sf))


@register("A32_movies_topic_overview", _topics_sql(
    "SELECT movie_name, total_reviews, reviews_positive_percentage AS positive_pct, "
    "reviews_negative_percentage AS negative_pct, reviews_neutral_percentage AS neutral_pct, "
    "total_topics AS topics_found, POSITIVE + MOSTLY_POSITIVE AS positive_topics, "
    "NEGATIVE + MOSTLY_NEGATIVE AS negative_topics FROM a30", doubles=("positive_pct", "negative_pct", "neutral_pct")))
def a32(spark, sf):
    """One row per movie with the positive and negative topic counts."""
    return M.movies_topic_overview(_a30_spark(spark, sf), KEYS)


@register("O4_topic_table", _topics_sql(
    "SELECT movie_name, topic, topic_size, dominant_sentiment, "
    + ", ".join(f"printf('%.1f%%', {_he(f'{lab}_percentage', 1)}) AS {lab}_pct" for lab in LABELS)
    + ", substr(coalesce(keyword_string, ''), 1, 60) AS keywords FROM a28"))
def o4(spark, sf):
    """O3 + O4 + T10: the sorted display table of topics."""
    return M.topic_table(_a28_spark(spark, sf), KEYS)


@register("W6_top_k", _topic_sql(
    "SELECT movie_name, topic, term, n FROM (SELECT *, row_number() OVER (PARTITION BY movie_name, topic "
    "ORDER BY n DESC, term) AS rk FROM terms) WHERE rk <= 3", _term_ctes()))
def w6(spark, sf):
    """The three most frequent terms per topic (ties by term)."""
    return M.top_k(_terms(spark, sf), ["movie_name", "topic"], 3, [F.col("n").desc(), F.col("term")])


@register("Z4_topic_sentiment_analysis")
def z4(spark, sf):
    """Z4 (P9 -> T5/T6 -> F2 -> A2 -> N19 -> M4/M5 -> A28-A31): movies with at least 10 texts, their overview and each of
    their topics with its keywords. The gate is the review count of the overview, so it needs no pass of its own."""
    out = M.topic_analysis(_levels(spark, sf), KEYS, M.topic_keywords(_terms(spark, sf), KEYS, 5), 10)
    return out.drop("top_keywords")


REGISTRY["Z4_topic_sentiment_analysis"].sql = _topics_sql(
    "SELECT m.movie_name, total_reviews, total_sentences, reviews_positive_percentage AS review_positive_pct, "
    "reviews_negative_percentage AS review_negative_pct, sentences_positive_percentage AS sentence_positive_pct, "
    "sentences_negative_percentage AS sentence_negative_pct, total_topics AS topics_found, "
    + ", ".join(f"t.{c}" for c in A28_COLS[1:]) + " FROM a30 m LEFT JOIN a28 t ON t.movie_name = m.movie_name "
    "WHERE m.movie_name IN (SELECT movie_name FROM v_topic GROUP BY movie_name HAVING count(*) >= 10)",
    doubles=("review_positive_pct", "review_negative_pct", "sentence_positive_pct", "sentence_negative_pct", *_A28_D))
