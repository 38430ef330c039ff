"""Number, label and array column functions (N1-N20 of the survey).

All are Spark built-in expressions; no Python UDF. Missing numbers are null, never NaN:
``nan_to_null`` is applied after every cast from text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelscope.functions.text import strip_ws


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_double(c) -> Column:
    """Text or number -> double; bad text, NaN -> null (pandas ``to_numeric(errors='coerce')``)."""
    return nan_to_null(strip_ws(_col(c).cast("string")).try_cast("double"))


def round_half_even(c, digits: int) -> Column:
    """Python ``round(x, d)`` on a float: half-even on ``x * 10**d``.

    ``bround(x, d)`` would round the decimal text of ``x`` instead (2.675 -> 2.68 where
    Python gives 2.67); scaling first rounds the binary value, as Python and DuckDB do.
    """
    scale = float(10 ** digits)
    return F.bround(_col(c) * F.lit(scale), 0) / F.lit(scale)


def _ratio_pct(text: Column) -> Column:
    parts = F.split(text, "/")
    num = to_double(F.element_at(parts, 1))
    den = to_double(F.element_at(parts, 2))
    return F.when(F.size(parts) == 2, F.try_divide(num, F.when(den != 0, den)) * F.lit(100.0))


def rating_pct_imdb(c) -> Column:
    """``a/b`` -> a/b*100; a plain number n -> n/10*100; anything else -> null."""
    s = strip_ws(_col(c).cast("string"))
    return (F.when(s.contains("/"), _ratio_pct(s))
             .otherwise(to_double(s) / F.lit(10.0) * F.lit(100.0)))


def rating_pct_ltbx(c) -> Column:
    """n/10*100 (the code's rule; the data is on 1-10)."""
    return to_double(c) / F.lit(10.0) * F.lit(100.0)


def rating_pct_rt(c) -> Column:
    """``a/b`` -> %, fresh -> 100, rotten -> 0, no score / '' -> null, other numbers
    pass unscaled, anything else -> null."""
    s = strip_ws(_col(c).cast("string"))
    low = F.lower(s)
    return (F.when(s.contains("/"), _ratio_pct(s))
             .when(low == "fresh", F.lit(100.0))
             .when(low == "rotten", F.lit(0.0))
             .when((low == "no score") | (s == ""), F.lit(None).cast("double"))
             .otherwise(to_double(s)))


def rating_pct(c, source) -> Column:
    """N1-N3 by the row's source (``imdb``, ``ltbx``, ``rt``)."""
    src = _col(source)
    return (F.when(src == "imdb", rating_pct_imdb(c))
             .when(src == "ltbx", rating_pct_ltbx(c))
             .when(src == "rt", rating_pct_rt(c)))


def clip_0_100(c) -> Column:
    """To number (bad -> null), then clipped to 0..100. Guarded: Spark ``least`` and
    ``greatest`` skip nulls, so an unguarded null would become 100."""
    x = to_double(c)
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def _label_rule(c, with_null_and_numeric: bool) -> Column:
    s = F.lower(_col(c).cast("string"))
    num = to_double(s)
    rule = (F.when(s.contains("pos") | s.contains("2"), F.lit("positive"))
             .when(s.contains("neg") | s.contains("0"), F.lit("negative"))
             .when(s.contains("neu") | s.contains("1"), F.lit("neutral")))
    if with_null_and_numeric:
        rule = (rule.when(num >= 0.6, F.lit("positive"))
                    .when(num <= 0.4, F.lit("negative"))
                    .when(num.isNotNull(), F.lit("neutral"))
                    .when(F.lower(strip_ws(s)) == "nan", F.lit("neutral")))
        return F.when(_col(c).isNull(), F.lit("neutral")).otherwise(rule.otherwise(s))
    return rule.otherwise(s)


def standardize_label(c) -> Column:
    """Null -> neutral; has ``pos`` or 2 -> positive; else ``neg`` or 0 -> negative;
    else ``neu`` or 1 -> neutral; else a number >= .6 positive, <= .4 negative, other
    neutral; else the lower-cased text. Order matters: ``0.9`` is negative."""
    return _label_rule(c, True)


def standardize_label_basic(c) -> Column:
    """N5 without the null rule and the numeric step."""
    return _label_rule(c, False)


def map_model_label(idx, id2label: dict[str, str] | None = None) -> Column:
    """Class index -> ``LABEL_i`` -> model name -> positive/negative/neutral by
    substring; without a mapping 0 negative, 1 neutral, 2 positive."""
    i = _col(idx).cast("long")
    raw = F.concat(F.lit("LABEL_"), i.cast("string"))
    if id2label:
        m = F.create_map(*[x for k, v in sorted(id2label.items()) for x in (F.lit(k), F.lit(v))])
        name = F.coalesce(F.element_at(m, raw), raw)
    else:
        name = (F.when(i == 0, F.lit("negative")).when(i == 1, F.lit("neutral"))
                 .when(i == 2, F.lit("positive")).otherwise(raw))
    low = F.lower(name)
    return (F.when(low.contains("neg"), F.lit("negative"))
             .when(low.contains("pos"), F.lit("positive"))
             .when(low.contains("neu"), F.lit("neutral"))
             .otherwise(name))


def softmax(arr) -> Column:
    """Logits -> probabilities (shifted by the max for stability)."""
    a = _col(arr).cast("array<double>")
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def argmax_index(probs) -> Column:
    """0-based index of the largest value, first on ties."""
    p = _col(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("long")


def signed_score(label, score) -> Column:
    """Weight positive 1, negative -2, anything else 0; times the score."""
    lab = _col(label)
    w = F.when(lab == "positive", F.lit(1.0)).when(lab == "negative", F.lit(-2.0)).otherwise(F.lit(0.0))
    return w * _col(score)


def review_score(sum_x, n, fold: bool = True) -> Column:
    """``abs(50 + 50/n * sum_x)``; ``fold=False`` keeps the sign."""
    v = F.lit(50.0) + F.try_divide(F.lit(50.0), _col(n).cast("double")) * _col(sum_x)
    return F.abs(v) if fold else v


def disconnect(mss, rating) -> Column:
    """``abs(mss - rating)``."""
    return F.abs(_col(mss) - _col(rating))


# Significance bands and their magnitude labels.
SIGNIFICANCE_LOW = "Low Significance"
SIGNIFICANCE_MODERATE = "Moderate Significance"
SIGNIFICANCE_HIGH = "High Significance"
MAGNITUDE_RANGE = {SIGNIFICANCE_LOW: "0-10%", SIGNIFICANCE_MODERATE: "11-25%", SIGNIFICANCE_HIGH: "> 25%"}


def significance(diff, keep_missing: bool = True) -> Column:
    """<= 10 Low, <= 25 Moderate, else High. A missing difference lands in High as in
    the reference (NaN compares false); ``keep_missing=False`` gives null instead."""
    d = _col(diff)
    rule = F.when(d <= 10, F.lit(SIGNIFICANCE_LOW)).when(d <= 25, F.lit(SIGNIFICANCE_MODERATE))
    if keep_missing:
        return rule.otherwise(F.lit(SIGNIFICANCE_HIGH))
    return rule.when(d.isNotNull(), F.lit(SIGNIFICANCE_HIGH))


def magnitude_range(cat) -> Column:
    """Band -> magnitude label."""
    c = _col(cat)
    out = None
    for k, v in MAGNITUDE_RANGE.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def correlation_strength(r) -> Column:
    """>0.7 strong positive, >0.3 moderate positive, >-0.3 weak, >-0.7 moderate
    negative, else strong negative (a null r falls in the last, as NaN does)."""
    x = _col(r)
    # The interpretation labels.
    return (F.when(x > 0.7, F.lit("Strong positive correlation"))
             .when(x > 0.3, F.lit("Moderate positive correlation"))
             .when(x > -0.3, F.lit("Weak or no correlation"))
             .when(x > -0.7, F.lit("Moderate negative correlation"))
             .otherwise(F.lit("Strong negative correlation")))


def pct(n, total, digits: int = 2) -> Column:
    """n/total*100 rounded half-even; 0 when total is 0."""
    t = _col(total).cast("double")
    v = F.when(t == 0, F.lit(0.0)).otherwise(_col(n).cast("double") / t * F.lit(100.0))
    return round_half_even(v, digits)


def dominant_sentiment(pos_pct, neg_pct, neu_pct) -> Column:
    """>50 % -> POSITIVE/NEGATIVE/NEUTRAL; else MOSTLY_POSITIVE when positive is not
    below the others, MOSTLY_NEGATIVE likewise, else MIXED."""
    p, n, u = _col(pos_pct), _col(neg_pct), _col(neu_pct)
    return (F.when(p > 50, F.lit("POSITIVE"))
             .when(n > 50, F.lit("NEGATIVE"))
             .when(u > 50, F.lit("NEUTRAL"))
             .when((p >= n) & (p >= u), F.lit("MOSTLY_POSITIVE"))
             .when((n >= p) & (n >= u), F.lit("MOSTLY_NEGATIVE"))
             .otherwise(F.lit("MIXED")))


def topic_params(n_docs) -> dict[str, Column]:
    """Topic-model parameters from the number of documents."""
    n = _col(n_docs).cast("long")
    min_size = F.when(n < 200, F.lit(3)).when(n < 1000, F.lit(10)).otherwise(F.lit(20)).cast("long")
    min_df = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(0.001))),
                     F.greatest(F.lit(1), F.floor(min_size * F.lit(0.5)))).cast("long")
    max_df = F.greatest(min_df + 1, F.floor(n * F.lit(0.8))).cast("long")
    return {"min_topic_size": min_size, "min_df": min_df, "max_df": max_df}


def score_bin(c, lo: float = 0.0, hi: float = 1.0, bins: int = 30) -> Column:
    """Equal-width histogram bin 1..bins of a score (values at ``hi`` go in the last bin)."""
    x = _col(c).cast("double")
    b = F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)) + 1
    return F.when(x.isNotNull(), F.least(F.greatest(b, F.lit(1)), F.lit(bins))).cast("long")
