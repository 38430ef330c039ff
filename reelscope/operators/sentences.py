"""Sentence tables and review votes (T4-T6, A2, A26, Z2 of the survey).

Splitting is a generator (``posexplode``) inside the scan's stage: no shuffle, whole texts.
The vote is one aggregate per review, partial, so a review with very many sentences does
not land in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelscope.functions.text import split_boundary, split_punct, word_count
from reelscope.operators.reshape import explode_list


def split_sentences_punct(df: DataFrame, text: str = "review_text", min_words: int = 2,
                          out: str = "sentence") -> DataFrame:
    """T4: split on runs of ``.!?``, trim, drop empties, number from 1, *then* drop pieces
    with fewer than ``min_words`` words (numbers keep their gaps). Empty texts and the
    text ``nan`` yield nothing. Other columns are carried along."""
    keep = [c for c in df.columns if c != text]
    t = F.col(text)
    src = df.filter(t.isNotNull() & (t != "") & (t != "nan"))
    exploded = explode_list(src, split_punct(t), keep, out, "_pos")
    return (exploded.filter(word_count(F.col(out)) >= min_words)
                    .withColumn("sentence_num", (F.col("_pos") + 1).cast("int"))
                    .select(*keep, "sentence_num", out))


def split_sentences_boundary(df: DataFrame, text: str = "review_text", min_len: int = 10,
                             out: str = "sentence_text", keep_empty: bool = False) -> DataFrame:
    """T5 (+ T6 with ``keep_empty``): boundary split, pieces of ``min_len``+ characters,
    end mark added, numbered from 0 after filtering. With ``keep_empty`` a text without
    sentences stays as one row with null ``sentence_index``."""
    keep = [c for c in df.columns if c != text]
    rows = explode_list(df, split_boundary(F.col(text), min_len), keep, out, "sentence_index", keep_empty)
    return rows.withColumn("sentence_index", F.col("sentence_index").cast("int"))


LABELS = ("positive", "negative", "neutral")


def review_vote(sentences: DataFrame, keys: list[str], label: str = "sentiment_label",
                score: str = "sentiment_score", position: str = "sentence_index",
                global_index: str | None = "global_index", labels: Sequence[str] = LABELS) -> DataFrame:
    """A2 (+ T6): per review the majority label (ties -> the label seen first), the mean
    score, the sentence count, the sentence positions and the label -> count map.

    One aggregate reads the sentences once and keeps a fixed-width buffer per review: a count and a first position
    for each of ``labels``, the score sum and the first ``global_index``. A sentence whose label is null or not in
    ``labels`` raises, so no vote is lost. Rows with a null ``position`` are reviews without sentences (T6): count 0,
    empty list, label neutral, score 0.0. ``global_index`` (the running sentence number over the whole table,
    contiguous per review) gives the position list as ``sequence(first, first + n - 1)``, so no unbounded
    ``collect_list`` is built.
    """
    real, lab = F.col(position).isNotNull(), F.col(label)
    aggs = [F.avg(F.when(real, F.col(score))).alias("_mean"), F.count(position).alias("sentence_count"),
            F.count_if(real & ~F.coalesce(lab.isin(*labels), F.lit(False))).alias("_other")]
    for i, name in enumerate(labels):
        hit = real & (lab == name)
        aggs += [F.count_if(hit).alias(f"_n{i}"), F.min(F.when(hit, F.col(position))).alias(f"_first{i}")]
    if global_index:
        aggs.append(F.min(F.when(real, F.col(global_index))).alias("_g0"))
    found = F.filter(F.array(*[F.struct(F.col(f"_n{i}").alias("n"), (-F.col(f"_first{i}")).alias("at"), F.lit(name).alias("label"))
                               for i, name in enumerate(labels)]), lambda v: v["n"] > 0)
    none = F.col("sentence_count") == 0
    # checked where every plan reads it, so that column pruning cannot drop the check
    count = F.when(F.col("_other") > 0, F.raise_error(F.lit("a sentence has a label outside the vote's labels")).cast("long")) \
             .otherwise(F.col("sentence_count"))
    out = [F.when(none, F.lit("neutral")).otherwise(F.array_max(found)["label"]).alias("sentiment_label"),
           F.map_from_entries(F.transform(found, lambda v: F.struct(v["label"], v["n"]))).alias("sentiment_distribution"),
           F.when(none, F.lit(0.0)).otherwise(F.col("_mean")).alias("sentiment_score"), count.alias("sentence_count")]
    if global_index:
        out.append(F.when(none, F.array().cast("array<bigint>")).otherwise(
            F.sequence(F.col("_g0"), F.col("_g0") + F.col("sentence_count") - 1)).alias("sentence_indices"))
    return sentences.groupBy(*keys).agg(*aggs).select(*keys, *out)


def sentences_per_review(reviews: DataFrame, sentences: DataFrame, key: str = "movie_name",
                         review_id: str = "review_id") -> DataFrame:
    """Reviews, sentences and mean sentences per review, per group (null is a group) and in
    total (group ``ALL``). Both tables are counted before they meet, by group, so a null group keeps its sentences;
    sentences of a group without reviews are left out."""
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = (reviews.select(key, one.alias("_r"), no.alias("_s")).groupBy(key).agg(F.sum("_r").alias("_r"), F.sum("_s").alias("_s"))
            .unionByName(sentences.select(key, no.alias("_r"), one.alias("_s")).groupBy(key).agg(F.sum("_r").alias("_r"), F.sum("_s").alias("_s"))))
    per = both.groupBy(key).agg(F.sum("_r").alias("_r"), F.sum("_s").alias("_s")).filter(F.col("_r") > 0)
    every = F.col("_all")
    twice = per.withColumn("_all", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(key, F.when(~every, F.col(key)))
    out = twice.groupBy("_all", key).agg(F.sum("_r").alias("reviews"), F.sum("_s").alias("sentences"))
    return out.select(F.when(every, F.lit("ALL")).otherwise(F.col(key)).alias(key), "reviews", "sentences",
                      F.try_divide(F.col("sentences").cast("double"), F.col("reviews")).alias("sentences_per_review"))


def global_sentence_index(df: DataFrame, keys: list[str], position: str = "sentence_index",
                          out: str = "global_index") -> DataFrame:
    """Running number of every sentence over the table in (review, position) order, as the
    reference's per-movie list index. Uses the skew-safe ``ordered_index``."""
    from reelscope.operators.ordering import ordered_index
    ranked = df.withColumn("_all", F.lit(0))
    return ordered_index(ranked, ["_all"], [*keys, position], out=out).drop("_all")
