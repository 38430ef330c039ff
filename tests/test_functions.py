"""Column functions: dates (D1-D3), numbers and labels (N1-N16), text."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelscope.functions import dates as DT
from reelscope.functions import numbers as N
from reelscope.functions import text as TX


def col_values(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


# ---------------------------------------------------------------- dates

DATE_CASES = [
    ("2024-03-05", dt.datetime(2024, 3, 5)),
    ("2024-03-05 14:07:09", dt.datetime(2024, 3, 5, 14, 7, 9)),
    ("2015-01-11T11:53:40.828Z", dt.datetime(2015, 1, 11, 11, 53, 40, 828000)),
    ("2015-01-11T11:53:40", dt.datetime(2015, 1, 11, 11, 53, 40)),
    ("Oct 9, 2024", dt.datetime(2024, 10, 9)),
    ("October 9, 2024", dt.datetime(2024, 10, 9)),
    ("9 Oct 2024", dt.datetime(2024, 10, 9)),
    ("9 October 2024", dt.datetime(2024, 10, 9)),
    ("Oct 09 2024", dt.datetime(2024, 10, 9)),
    ("October 9 2024", dt.datetime(2024, 10, 9)),
    ("05/09/2018", dt.datetime(2018, 5, 9)),       # month first wins
    ("30/11/2019", dt.datetime(2019, 11, 30)),     # falls through to day first
    ("1998/7/4", dt.datetime(1998, 7, 4)),
    ("8-Feb-2003", dt.datetime(2003, 2, 8)),
    ("19-August-1987", dt.datetime(1987, 8, 19)),
    ("2011.06.21", dt.datetime(2011, 6, 21)),
    ("2007_1_31", dt.datetime(2007, 1, 31)),
    ("Apr 17", dt.datetime(2025, 4, 17)),          # year filled in
    ("April 17", dt.datetime(2025, 4, 17)),
    ("17 Apr", dt.datetime(2025, 4, 17)),
    ("17 April", dt.datetime(2025, 4, 17)),
    ("Feb 29", None),                              # not a date in 2025
    ("  2024-03-05 \t", dt.datetime(2024, 3, 5)),
    (" N/A ", None), ("nan", None), ("NaT", None), ("", None), (None, None),
    ("yesterday", None), ("2024-13-01", None),
]


def test_parse_review_date_all_formats(spark):
    got = col_values(spark, [c for c, _ in DATE_CASES], lambda c: DT.parse_review_date(c, 2025))
    assert got == [e for _, e in DATE_CASES]


def test_dates_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2024-03-10 02:30:00", "1883-11-18 12:01:00", "Apr 17,", "2024-03-05T01:02:03.4567Z"]
    try:
        for name in ("America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
            got = [r[0] for r in df.orderBy("i").select(DT.parse_review_date("v", 2025).cast("string")).collect()]
            assert got == ["2024-03-10 02:30:00", "1883-11-18 12:01:00", None, "2024-03-05 01:02:03.4567"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_missing_tokens(spark):
    vals = ["", "nan", "None", "NaT", "null", "NaN", "N/A", "n/a", " N/A ", "x", None]
    got = col_values(spark, vals, DT.is_missing_token)
    assert got == [True] * 9 + [False, True]


FORMS = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%b %d, %Y", "%B %d, %Y", "%d %b %Y", "%d-%b-%Y", "%Y/%m/%d",
         "%Y.%m.%d", "%Y_%m_%d"]


@settings(max_examples=25, deadline=None)
@given(st.datetimes(min_value=dt.datetime(1950, 1, 1), max_value=dt.datetime(2049, 12, 31)),
       st.sampled_from(FORMS))
def test_parse_review_date_roundtrip(spark, stamp, form):
    text = stamp.strftime(form)
    expect = dt.datetime.strptime(text, form)
    assert col_values(spark, [text], lambda c: DT.parse_review_date(c, 2025)) == [expect]


# ---------------------------------------------------------------- ratings and labels

def test_rating_scales(spark):
    assert col_values(spark, ["7/10", "10", "1/2/3", "No Rating", "", "4/0"], N.rating_pct_imdb) == \
        [70.0, 100.0, None, None, None, None]
    assert col_values(spark, ["1", "8", "", "x"], N.rating_pct_ltbx) == [10.0, 80.0, None, None]
    assert col_values(spark, ["4.5/5", "Fresh", "rotten", "No Score", "", "87", "meh"], N.rating_pct_rt) == \
        [90.0, 100.0, 0.0, None, None, 87.0, None]


def test_clip_keeps_null_and_nan(spark):
    got = col_values(spark, [None, -5.0, 50.0, 150.0, float("nan")], N.clip_0_100, "double")
    assert got == [None, 0.0, 50.0, 100.0, None]


def test_standardize_label_order(spark):
    vals = [None, "POS", "LABEL_2", "LABEL_0", "0.9", ".7", "neutral", "0.5", "x", "Negative"]
    got = col_values(spark, vals, N.standardize_label)
    assert got == ["neutral", "positive", "positive", "negative", "negative", "positive", "neutral",
                   "negative", "x", "negative"]


def test_significance_and_ranges(spark):
    got = col_values(spark, [0.0, 10.0, 10.5, 25.0, 25.01, None], N.significance, "double")
    assert got == ["Low Significance", "Low Significance", "Moderate Significance", "Moderate Significance",
                   "High Significance", "High Significance"]
    keep = col_values(spark, [None], lambda c: N.significance(c, keep_missing=False), "double")
    assert keep == [None]
    assert col_values(spark, ["Low Significance", "High Significance"], N.magnitude_range) == ["0-10%", "> 25%"]


def test_review_score_folds(spark):
    df = spark.createDataFrame([(-1.0 * 2, 1), (0.5, 2)], "s double, n int")
    rows = df.select(N.review_score(F.col("s"), F.col("n")).alias("a"),
                     N.review_score(F.col("s"), F.col("n"), fold=False).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(50.0, -50.0), (62.5, 62.5)]


def test_pct_half_even(spark):
    df = spark.createDataFrame([(1, 8), (0, 0), (1, 3)], "n int, t int")
    got = [r[0] for r in df.select(N.pct(F.col("n"), F.col("t"), 1)).collect()]
    assert got == [12.5, 0.0, 33.3]
    assert col_values(spark, [2.5, 0.125, 3.5], lambda c: N.round_half_even(c, 0), "double") == [2.0, 0.0, 4.0]


def test_dominant_sentiment(spark):
    df = spark.createDataFrame([(60.0, 20.0, 20.0), (50.0, 50.0, 0.0), (30.0, 30.0, 40.0), (20.0, 40.0, 40.0)],
                               "p double, n double, u double")
    got = [r[0] for r in df.select(N.dominant_sentiment(F.col("p"), F.col("n"), F.col("u"))).collect()]
    assert got == ["POSITIVE", "MOSTLY_POSITIVE", "MIXED", "MOSTLY_NEGATIVE"]


def test_softmax_argmax_first_on_ties(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0],), ([0.0, 0.5, 2.0],)], "a array<double>")
    rows = df.select(N.softmax(F.col("a")).alias("p")).select("p", N.argmax_index(F.col("p")).alias("i")).collect()
    assert [r.i for r in rows] == [0, 2]
    assert all(abs(sum(r.p) - 1.0) < 1e-12 for r in rows)


# ---------------------------------------------------------------- text

def test_strip_emojis_and_ws(spark):
    got = col_values(spark, ["Great \U0001F600 film", "flag \U0001F1F5\U0001F1ED", "漢字 ok", None],
                     TX.strip_emojis)
    assert got == ["Great  film", "flag ", " ok", None]
    assert col_values(spark, ["\t a b \n"], TX.strip_ws) == ["a b"]


def test_title_plus_text_and_slug(spark):
    df = spark.createDataFrame([("T", "x"), (None, "x"), ("T", None), (None, None)], "t string, x string")
    got = [r[0] for r in df.select(TX.title_plus_text(F.col("t"), F.col("x"))).collect()]
    assert got == ["T: x", "x", "", ""]
    assert col_values(spark, ["Hayop Ka!", "Maid in Malacañang"], TX.slug) == ["hayop_ka", "maid_in_malacanang"]


def test_ngrams_bridge_removed_words(spark):
    df = spark.createDataFrame([("The film was a GOOD film, ang ganda",)], "t string")
    got = df.select(TX.tokenize_ngrams(F.col("t"), ["the", "was", "a", "ang"]).alias("g")).first().g
    assert got == ["film", "good", "film", "ganda", "film good", "good film", "film ganda"]


@pytest.mark.parametrize("pct,text", [(12.345, "12.3%"), (0.0, "0.0%")])
def test_format_pct(spark, pct, text):
    assert col_values(spark, [pct], TX.format_pct, "double") == [text]
