"""Sentence scoring (F1-F3 of the survey).

F1 runs a user's model over Arrow batches with ``predict_batch_udf`` (the model is
loaded once per Python worker, batches of ``batch_size`` rows). F2 is the built-in default
scorer: a word lexicon evaluated with Spark expressions (no Python), producing the same
columns (label, confidence, three probabilities). F3 keeps empty texts as rows with a null
score instead of dropping them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions.numbers import map_model_label
from reelscope.functions.text import strip_ws

# The default lexicon (our own; the reference ships a model instead).
POSITIVE_WORDS = ["good", "great", "best", "love", "loved", "excellent", "amazing", "beautiful", "wonderful",
                  "nice", "enjoyed", "brilliant", "perfect", "fun", "recommend", "ganda", "maganda", "galing",
                  "magaling", "saya", "masaya", "sulit", "bilib", "astig", "bien", "gut", "bueno", "bon"]
NEGATIVE_WORDS = ["bad", "worst", "boring", "hate", "terrible", "awful", "waste", "poor", "disappointing",
                  "weak", "pangit", "panget", "sayang", "nakakainis", "nakakaantok", "korni", "baduy",
                  "mal", "schlecht", "malo", "mauvais"]
NEUTRAL_LOGIT = 0.5

SCORE_FIELDS = ["sentiment", "confidence", "prob_negative", "prob_neutral", "prob_positive"]


def _word_alternation(words: list[str]) -> str:
    """A pattern matching one whole token equal to one of ``words`` (tokens are maximal
    runs of word characters, as in ``tokens``)."""
    starts = "".join(sorted({re.sub(r"([\\\]\[^&-])", r"\\\1", w[0]) for w in words if w}))
    ahead = f"(?=[{starts}])" if starts and all(words) else ""  # most characters begin no word of the list

    def tree(some: set[str]) -> str:
        arms = [re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c) + tree({w[1:] for w in some if w[:1] == c}) for c in sorted({w[0] for w in some if w})]
        return "" if not arms else f"(?:{'|'.join(arms)})" + ("?" if "" in some else "")
    return f"(?U){ahead}\\b{tree(set(words))}\\b"


def lexicon_logits(text, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS) -> Column:
    """Three logits (negative, neutral, positive): negative-word count, a constant, and
    positive-word count. Each count is one ``regexp_count`` pass over the lower-cased text
    (no token array is built), equal to counting the lexicon's words among ``tokens``."""
    low = F.lower(text if isinstance(text, Column) else F.col(text))
    n_pos = F.regexp_count(low, F.lit(_word_alternation(positive))).cast("double")
    n_neg = F.regexp_count(low, F.lit(_word_alternation(negative))).cast("double")
    return F.array(n_neg, F.lit(NEUTRAL_LOGIT), n_pos)


def with_scores(df: DataFrame, logits: Column, id2label: dict[str, str] | None = None,
                keep: Column | None = None) -> DataFrame:
    """N8 + N9 + N7 for three logits (negative, neutral, positive): adds ``sentiment``,
    ``confidence`` and the three probabilities; rows where ``keep`` is false get nulls.

    Scalar expressions on the three elements instead of ``transform`` / ``aggregate``, in
    stages (each value is computed once and stays a column, so the optimizer does not
    copy the exponentials into every consumer); the arithmetic is that of ``softmax`` /
    ``argmax_index``: shift by the max, sum left to right, first index on ties."""
    s = df.withColumn("_l", logits)
    s = s.withColumns({"_a": F.col("_l")[0].cast("double"), "_b": F.col("_l")[1].cast("double"),
                       "_c": F.col("_l")[2].cast("double")}).drop("_l")
    s = s.withColumn("_m", F.greatest("_a", "_b", "_c"))
    s = s.withColumns({"_ea": F.exp(F.col("_a") - F.col("_m")), "_eb": F.exp(F.col("_b") - F.col("_m")),
                       "_ec": F.exp(F.col("_c") - F.col("_m"))})
    s = s.withColumn("_t", F.col("_ea") + F.col("_eb") + F.col("_ec"))
    s = s.withColumns({"prob_negative": F.col("_ea") / F.col("_t"), "prob_neutral": F.col("_eb") / F.col("_t"),
                       "prob_positive": F.col("_ec") / F.col("_t")})
    s = s.withColumn("confidence", F.greatest("prob_negative", "prob_neutral", "prob_positive"))
    top = F.col("confidence")
    idx = (F.when(F.col("prob_negative") == top, F.lit(0)).when(F.col("prob_neutral") == top, F.lit(1))
            .otherwise(F.lit(2)))
    s = s.withColumn("sentiment", map_model_label(idx, id2label))
    s = s.drop("_a", "_b", "_c", "_m", "_ea", "_eb", "_ec", "_t")
    if keep is not None:
        s = s.withColumns({c: F.when(keep, F.col(c)) for c in SCORE_FIELDS})
    return s


def lexicon_scorer(df: DataFrame, text: str, positive: list[str] = POSITIVE_WORDS,
                   negative: list[str] = NEGATIVE_WORDS) -> DataFrame:
    """F2 (+ F3): adds the score columns; empty texts get null scores and stay."""
    d = df.withColumn("_keep", ~score_missing_texts(df, text))
    return with_scores(d, lexicon_logits(F.col(text), positive, negative), keep=F.col("_keep")).drop("_keep")


def score_sentences(df: DataFrame, text: str, make_predict_fn: Callable[[], Callable], batch_size: int = 32,
                    id2label: dict[str, str] | None = None) -> DataFrame:
    """model scoring over Arrow batches.

    ``make_predict_fn()`` is called once per Python worker and returns
    ``predict(texts: numpy array of str) -> numpy array (n, 3) of logits``; tokenisation
    and the model (batch 32 and 256 tokens in the reference's sentence job) live inside
    it. Empty texts are not sent to the model (F3) and get null scores. The input is read once.
    """
    from pyspark.ml.functions import predict_batch_udf

    def skip_empty():
        import numpy as np
        model = make_predict_fn()

        def run(texts):
            out = np.zeros((len(texts), 3))
            full = np.array([t != "" for t in texts], dtype=bool)
            if full.any():
                out[full] = model(texts[full])
            return out
        return run

    predict = predict_batch_udf(skip_empty, return_type=T.ArrayType(T.DoubleType()),
                                batch_size=batch_size, input_tensor_shapes=None)
    d = df.withColumn("_keep", ~score_missing_texts(df, text))
    d = d.withColumn("_logits", predict(F.when(F.col("_keep"), F.col(text)).otherwise(F.lit(""))))
    return with_scores(d, F.col("_logits"), id2label, keep=F.col("_keep")).drop("_keep", "_logits")


def score_missing_texts(df: DataFrame, text: str) -> Column:
    """true for rows that are not sent to a model (null or blank text)."""
    return strip_ws(F.coalesce(F.col(text), F.lit(""))) == ""
