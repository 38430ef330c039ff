"""Review-shaped views over the driver tables (survey §7.3).

Each view exists twice: as a Spark DataFrame (used by the registered queries) and as a
DuckDB SQL fragment (used by the oracle). Both are built from the same columns with the
same rules, so no reference data is needed. The views only rename, derive and null out
values; none of them drops rows to make a check cheaper.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.operators.ordering import ordered_index
from reelscope.session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# Tables whose rows carry long texts: their operators are CPU-bound per row.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


# Raw date texts for the date parser: (Spark pattern, DuckDB strftime pattern), chosen by
# review_id % 21. Index 19 is a missing token, 20 is junk.
RAW_DATE_FORMS = [
    ("yyyy-MM-dd", "%Y-%m-%d"),
    ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    ("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "%Y-%m-%dT%H:%M:%S.%gZ"),
    ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    ("MMM d, yyyy", "%b %-d, %Y"),
    ("MMMM d, yyyy", "%B %-d, %Y"),
    ("d MMM yyyy", "%-d %b %Y"),
    ("dd MMMM yyyy", "%d %B %Y"),
    ("MMM dd yyyy", "%b %d %Y"),
    ("MMMM d yyyy", "%B %-d %Y"),
    ("MM/dd/yyyy", "%m/%d/%Y"),
    ("d/M/yyyy", "%-d/%-m/%Y"),
    ("yyyy/MM/dd", "%Y/%m/%d"),
    ("dd-MMM-yyyy", "%d-%b-%Y"),
    ("d-MMMM-yyyy", "%-d-%B-%Y"),
    ("yyyy.MM.dd", "%Y.%m.%d"),
    ("yyyy_MM_dd", "%Y_%m_%d"),
    ("MMM d", "%b %-d"),
    ("d MMMM", "%-d %B"),
]


# ------------------------------------------------------------------ V_REV (reviews)

def v_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews from ``orders``: one review per order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    # a time of day so that the time-keeping formats have something to keep
    stamp = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))
    form = k % 21
    raw_date = F.lit("yesterday")
    for i in reversed(range(len(RAW_DATE_FORMS))):
        raw_date = F.when(form == i, F.date_format(stamp, RAW_DATE_FORMS[i][0])).otherwise(raw_date)
    raw_date = F.when(form == 19, F.lit(" N/A ")).otherwise(raw_date)
    c = F.col("o_custkey")
    rform = k % 9
    raw_rating = (F.when(rform == 0, (c % 101).cast("string"))
                   .when(rform == 1, F.concat((c % 10 + 1).cast("string"), F.lit("/10")))
                   .when(rform == 2, F.concat(((c % 10) / 2).cast("string"), F.lit("/5")))
                   .when(rform == 3, F.lit("No Rating"))
                   .when(rform == 4, F.lit("Fresh"))
                   .when(rform == 5, F.lit("rotten"))
                   .when(rform == 6, F.lit("No Score"))
                   .when(rform == 7, F.lit(""))
                   .otherwise(F.lit("1/2/3")))
    return o.select(
        k.alias("review_id"),
        F.col("o_orderpriority").alias("movie_name"),
        c.cast("string").alias("username"),
        F.when(k % 19 != 0, F.col("o_orderdate")).alias("date"),
        (F.when(k % 23 == 0, F.lit(None).cast("string"))
          .when(k % 29 == 0, F.lit(""))
          .otherwise(F.concat(F.col("o_orderpriority"), F.lit(" review "), c.cast("string")))).alias("review_text"),
        F.when(k % 17 != 0, F.floor(F.col("o_totalprice") / 50.0) / 100.0).alias("rating"),
        (F.when(F.col("o_orderstatus") == "F", F.lit("imdb"))
          .when(F.col("o_orderstatus") == "O", F.lit("ltbx"))
          .when(F.col("o_orderstatus") == "P", F.lit("rt"))).alias("source"),
        raw_date.alias("raw_date"),
        raw_rating.alias("raw_rating"),
    )


def _sql_raw_date() -> str:
    stamp = "(o_orderdate + to_seconds(o_orderkey % 86400))"
    arms = " ".join(f"WHEN {i} THEN strftime({stamp}, '{d}')" for i, (_, d) in enumerate(RAW_DATE_FORMS))
    return f"CASE o_orderkey % 21 {arms} WHEN 19 THEN ' N/A ' ELSE 'yesterday' END"


SQL_V_REV = f"""v_rev AS (
  SELECT o_orderkey AS review_id,
         o_orderpriority AS movie_name,
         CAST(o_custkey AS VARCHAR) AS username,
         CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate END AS date,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN ''
              ELSE o_orderpriority || ' review ' || CAST(o_custkey AS VARCHAR) END AS review_text,
         CASE WHEN o_orderkey % 17 <> 0 THEN floor(o_totalprice / 50.0) / 100.0 END AS rating,
         CASE o_orderstatus WHEN 'F' THEN 'imdb' WHEN 'O' THEN 'ltbx' WHEN 'P' THEN 'rt' END AS source,
         {_sql_raw_date()} AS raw_date,
         CASE o_orderkey % 9
              WHEN 0 THEN CAST(o_custkey % 101 AS VARCHAR)
              WHEN 1 THEN CAST(o_custkey % 10 + 1 AS VARCHAR) || '/10'
              WHEN 2 THEN CAST((o_custkey % 10) / 2 AS VARCHAR) || '/5'
              WHEN 3 THEN 'No Rating' WHEN 4 THEN 'Fresh' WHEN 5 THEN 'rotten'
              WHEN 6 THEN 'No Score' WHEN 7 THEN '' ELSE '1/2/3' END AS raw_rating
  FROM orders)"""


# ------------------------------------------------------------------ V_SENT (scored sentences)

def _sent_label(event_type):
    return (F.when(event_type.isin("purchase", "signup"), F.lit("positive"))
             .when(event_type == "error", F.lit("negative"))
             .otherwise(F.lit("neutral")))


def v_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored sentences (form B) from ``events``: a user is a review, an event a sentence."""
    e = table(spark, sf_dir, "events")
    base = e.select(
        F.concat(F.lit("movie_"), (F.col("user_id") % 5).cast("string")).alias("movie_name"),
        F.col("user_id").alias("review_index"),
        F.col("event_id"),
        F.col("ts"),
        F.col("event_type").alias("sentence_text"),
        _sent_label(F.col("event_type")).alias("sentiment_label"),
        F.when(F.col("value") / 500.0 > 1.0, F.lit(1.0)).otherwise(F.col("value") / 500.0).alias("sentiment_score"),
        F.col("value"),
    )
    return ordered_index(base, ["review_index"], ["event_id"], out="sentence_index")


SQL_V_SENT = """v_sent AS (
  SELECT 'movie_' || CAST(user_id % 5 AS VARCHAR) AS movie_name,
         user_id AS review_index,
         event_id,
         ts,
         event_type AS sentence_text,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment_label,
         CASE WHEN value / 500.0 > 1.0 THEN 1.0 ELSE value / 500.0 END AS sentiment_score,
         value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sentence_index
  FROM events)"""


def v_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence metadata (the cleaning step's sentence table) from ``events``: numbered
    from 1 in event order, every event kept."""
    e = table(spark, sf_dir, "events")
    numbered = ordered_index(e, ["user_id"], ["event_id"], out="_pos")
    return numbered.select(
        F.col("user_id").alias("review_id"),
        (F.col("_pos") + 1).alias("sentence_num"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.col("ts").alias("date"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value")) % 101).cast("double").alias("rating"),
        (F.when(F.col("value") < 100, F.lit("imdb")).when(F.col("value") < 250, F.lit("ltbx"))
          .otherwise(F.lit("rt"))).alias("source"),
    )


SQL_V_META = """v_meta AS (
  SELECT review_id, sentence_num, username, date, rating, source FROM (
    SELECT user_id AS review_id,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sentence_num,
           'user_' || CAST(user_id AS VARCHAR) AS username,
           ts AS date,
           CAST(CASE WHEN event_type <> 'error' THEN floor(value) % 101 END AS DOUBLE) AS rating,
           CASE WHEN value < 100 THEN 'imdb' WHEN value < 250 THEN 'ltbx' ELSE 'rt' END AS source
    FROM events))"""


# ------------------------------------------------------------------ V_DOC, V_EMB, V_PAGE, V_TURN

def v_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


SQL_V_DOC = "v_doc AS (SELECT doc_id, text, lang, source FROM documents)"


def v_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a ready topic id; every 11th vector is an outlier (-1)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "embedding",
                    F.when(F.col("vec_id") % 11 == 0, F.lit(-1)).otherwise(F.col("label")).cast("long").alias("topic"))


SQL_V_EMB = """v_emb AS (
  SELECT vec_id, embedding, CAST(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS BIGINT) AS topic
  FROM embeddings)"""


def v_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


SQL_V_PAGE = "v_page AS (SELECT page_id, url, html FROM pages)"


def v_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


SQL_V_TURN = "v_turn AS (SELECT conv_id, turn, role, text FROM conversations)"


def with_views(sql: str, *views: str) -> str:
    """Prefix a query with the views it uses."""
    return "WITH " + ",\n".join(views) + "\n" + sql


# ------------------------------------------------------------------ V_SCORED, V_LABEL

def v_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored sentences (form A: raw model label, confidence, rating text, source) from
    ``events``; the raw labels are in several spellings so that N5 has work to do."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return e.select(
        F.concat(F.lit("movie_"), (F.col("user_id") % 5).cast("string")).alias("movie_name"),
        F.col("user_id").alias("review_id"),
        F.col("event_id"),
        (F.when(et == "purchase", F.lit("POS")).when(et == "signup", F.lit("positive"))
          .when(et == "error", F.lit("LABEL_0")).when(et == "view", F.lit("neutral"))).alias("sentiment"),
        F.when(F.col("value") / 500.0 > 1.0, F.lit(1.0)).otherwise(F.col("value") / 500.0).alias("confidence"),
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
         .otherwise((F.floor(F.col("value")) % 101).cast("string")).alias("rating"),
        (F.when(F.col("value") < 100, F.lit("imdb")).when(F.col("value") < 250, F.lit("ltbx"))
          .otherwise(F.lit("rt"))).alias("source"),
    )


SQL_V_SCORED = """v_scored AS (
  SELECT 'movie_' || CAST(user_id % 5 AS VARCHAR) AS movie_name, user_id AS review_id, event_id,
         CASE event_type WHEN 'purchase' THEN 'POS' WHEN 'signup' THEN 'positive' WHEN 'error' THEN 'LABEL_0'
              WHEN 'view' THEN 'neutral' END AS sentiment,
         CASE WHEN value / 500.0 > 1.0 THEN 1.0 ELSE value / 500.0 END AS confidence,
         CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value) % 101 AS BIGINT) AS VARCHAR) END AS rating,
         CASE WHEN value < 100 THEN 'imdb' WHEN value < 250 THEN 'ltbx' ELSE 'rt' END AS source
  FROM events)"""


def v_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the label table's quality flag as a ready sentiment (null when the
    document has no label row)."""
    d = v_doc(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = d.join(lab, "doc_id", "left")
    return j.withColumn("sentiment", F.when(F.col("quality") == 1, F.lit("positive"))
                                      .when(F.col("quality") == 0, F.lit("negative")))


SQL_V_LABEL = """v_label AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic,
         CASE WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'negative' END AS sentiment
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


# ------------------------------------------------------------------ V_TOPIC (texts with a ready topic)

def v_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a ready topic id: the label of its embedding (-1 for the outliers
    of ``v_emb``), or ``doc_id`` modulo 10 where it has none; the language plays the movie."""
    d = v_doc(spark, sf_dir)
    e = v_emb(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "topic")
    return d.join(e, "doc_id", "left").select(
        "doc_id", F.col("lang").alias("movie_name"), F.col("text").alias("review_text"),
        F.coalesce("topic", (F.col("doc_id") % 10).cast("long")).alias("topic"))


SQL_V_TOPIC = """v_topic AS (
  SELECT d.doc_id, d.lang AS movie_name, d.text AS review_text,
         CAST(coalesce(CASE WHEN e.vec_id % 11 = 0 THEN -1 ELSE e.label END, d.doc_id % 10) AS BIGINT) AS topic
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""
