"""Date column functions (D1-D9 of the survey).

Every function here returns a ``Column`` built from Spark built-ins, so it stays inside
whole-stage codegen and works the same on batch and streaming DataFrames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.functions.text import strip_ws

# Tokens read as missing, after trimming (pandas read_csv plus the
# cleaning notebook's own list).
MISSING_TOKENS = ["", "nan", "None", "NaT", "null", "NaN", "N/A", "n/a"]

# The review date formats, in the order they are tried (first hit wins,
# the whole text must match). strptime form -> Spark pattern.
DATE_FORMATS = [
    ("%Y-%m-%d", "yyyy-M-d"),
    ("%Y-%m-%d %H:%M:%S", "yyyy-M-d H:m:s"),
    ("%Y-%m-%dT%H:%M:%S.%f", "yyyy-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    ("%Y-%m-%dT%H:%M:%S", "yyyy-M-d'T'H:m:s"),
    ("%b %d, %Y", "MMM d, yyyy"),
    ("%B %d, %Y", "MMMM d, yyyy"),
    ("%d %b %Y", "d MMM yyyy"),
    ("%d %B %Y", "d MMMM yyyy"),
    ("%b %d %Y", "MMM d yyyy"),
    ("%B %d %Y", "MMMM d yyyy"),
    ("%m/%d/%Y", "M/d/yyyy"),
    ("%d/%m/%Y", "d/M/yyyy"),
    ("%Y/%m/%d", "yyyy/M/d"),
    ("%d-%b-%Y", "d-MMM-yyyy"),
    ("%d-%B-%Y", "d-MMMM-yyyy"),
    ("%Y.%m.%d", "yyyy.M.d"),
    ("%Y_%m_%d", "yyyy_M_d"),
]
# Formats without a year; the year is supplied by the caller.
YEARLESS_FORMATS = [
    ("%b %d", "MMM d yyyy"),
    ("%B %d", "MMMM d yyyy"),
    ("%d %b", "d MMM yyyy"),
    ("%d %B", "d MMMM yyyy"),
]
# The texts that the year-less formats read.
YEARLESS = "^(?:[A-Za-z]{3,} [0-9]{1,2}|[0-9]{1,2} [A-Za-z]{3,})$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing_token(c) -> Column:
    """D3: true when the trimmed text is one of the missing-value tokens (or null)."""
    s = strip_ws(_col(c).cast("string"))
    return s.isNull() | s.isin(MISSING_TOKENS)


def null_if_missing(c) -> Column:
    """D3: the trimmed text, or null for a missing-value token."""
    s = strip_ws(_col(c).cast("string"))
    return F.when(~is_missing_token(c), s)


def _ntz(text: Column, pattern) -> Column:
    # parsed as UTC and rebuilt from the microseconds, so the session zone has no say
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    micros = F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" +00:00")), F.concat(pattern, F.lit(" XXX"))))
    seconds = (micros.cast("decimal(18,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)


def _shape_of(pattern: str) -> str:
    """The shape (see ``text_shape``) of the texts a date pattern reads."""
    marks = {"yyyy": "Y", "MMMM": "b", "MMM": "a", "'T'": "a"}
    return re.sub(r"(?:\[S+\])+|yyyy|MMMM|MMM|'T'|[MdHms]", lambda m: marks.get(m[0], "9"), pattern)


def text_shape(text: Column) -> Column:
    """The text with runs of letters as ``a`` (``b`` from four letters on) and runs of digits as
    ``9`` (``Y`` from four digits on); the fraction of a second is always ``9``."""
    for runs, mark in ((r"(:[0-9]+)\.[0-9]{1,6}$", "$1.9"), ("[A-Za-z]{4,}", "b"), ("[ac-zA-Z][A-Za-z]*", "a"),
                       ("[0-9]{4,}", "Y"), ("[0-9]+", "9")):
        text = F.regexp_replace(text, runs, mark)
    return text


def parse_date_strict(c, pattern: str) -> Column:
    """One format, anything else null (rows are then dropped with P4)."""
    return _ntz(_col(c).cast("string"), pattern)


def fill_missing_year(text: Column, year: int) -> Column:
    """Parse the year-less forms ("Apr 17", "17 April") in the given year.

    The reference puts in the current year; here the year is a parameter so results
    do not depend on the day a job runs. Feb 29 in a non-leap year stays null.
    """
    with_year = F.when(text.rlike(YEARLESS), F.concat(text, F.lit(f" {int(year)}")))
    return _ntz(with_year, _pattern_for(with_year, [p for _, p in YEARLESS_FORMATS]))


def _pattern_for(text: Column, patterns: list[str]) -> Column:
    """The first of ``patterns`` whose shape the text has, else null."""
    by_shape: dict[str, str] = {}
    for p in patterns:
        by_shape.setdefault(_shape_of(p), p)
    known = F.create_map(*[F.lit(x) for pair in by_shape.items() for x in pair])
    return F.try_element_at(known, text_shape(text))


def parse_review_date(c, as_of_year: int, rewrite_1900: bool = False) -> Column:
    """Review date text -> timestamp_ntz.

    Trim, missing tokens -> null, drop every ``Z`` when the text has both ``T`` and ``Z``,
    then the formats in order (first hit wins), then the year-less forms (D2).
    ``rewrite_1900`` also moves a real year-1900 date to ``as_of_year`` as the reference does.

    The shape of the text picks the one format that can read it, so a row is parsed once; only
    ``9/9/Y`` has two readings, month first and then day first.
    """
    s = null_if_missing(c)
    s = F.when(s.contains("T") & s.contains("Z"), F.regexp_replace(s, "Z", "")).otherwise(s)
    s = F.when(s.rlike(YEARLESS), F.concat(s, F.lit(f" {int(as_of_year)}"))).otherwise(s)
    day_first = F.when(s.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), _ntz(s, "d/M/yyyy"))
    parsed = F.coalesce(_ntz(s, _pattern_for(s, [p for _, p in DATE_FORMATS])), day_first)
    if rewrite_1900:
        parsed = F.when(
            F.year(parsed) == 1900,
            F.make_timestamp_ntz(
                F.lit(int(as_of_year)), F.month(parsed), F.dayofmonth(parsed),
                F.hour(parsed), F.minute(parsed), F.second(parsed)
            ),
        ).otherwise(parsed)
    return parsed


def month_of(c) -> Column:
    """First day of the month, as a date."""
    return F.date_trunc("month", _col(c)).cast("date")


def month_parts(df: DataFrame, month_col: str = "month") -> DataFrame:
    """``month_name`` (Jan 2024), ``month_short`` (Jan), ``year``, ``month_num``."""
    m = F.col(month_col)
    return df.withColumns({
        "month_name": F.date_format(m, "MMM yyyy"),
        "month_short": F.date_format(m, "MMM"),
        "year": F.year(m),
        "month_num": F.month(m),
    })


def days_between_floor(later, earlier) -> Column:
    """Whole elapsed days (floor), as pandas ``.dt.days`` gives for a timedelta."""
    secs = F.unix_seconds(_col(later).cast("timestamp")) - F.unix_seconds(_col(earlier).cast("timestamp"))
    return F.floor(secs / F.lit(86400)).cast("long")


def days_since_first(df: DataFrame, key, date_col: str = "date", out: str = "days_since_first") -> DataFrame:
    """Whole days since the earliest date of the group.

    The per-group minimum is a partial aggregate joined back on the key; the joined side
    has one row per group, and AQE turns the join into a broadcast when it is small.
    """
    keys = [key] if isinstance(key, str) else list(key)
    first = df.groupBy(*keys).agg(F.min(date_col).alias("_first_date"))
    return (df.join(first, keys, "left")
              .withColumn(out, days_between_floor(F.col(date_col), F.col("_first_date")))
              .drop("_first_date"))


def review_days(df: DataFrame, key, date_col: str = "date") -> DataFrame:
    """Distinct calendar days with a review per group, as ``yyyy-MM-dd`` text."""
    keys = [key] if isinstance(key, str) else list(key)
    return (df.filter(F.col(date_col).isNotNull())
              .select(*keys, F.date_format(F.to_date(date_col), "yyyy-MM-dd").alias("review_day"))
              .distinct())


def quarter_label(df: DataFrame, key, month_col: str = "month", min_months: int = 12) -> DataFrame:
    """``Q<n> <year>`` tick labels of a monthly series.

    Labelled rows are the quarter starts (Jan/Apr/Jul/Oct) plus the last month when its
    label differs from the last one given; only series longer than ``min_months`` get labels.
    The windows run over one group's months, which is small (months, not reviews).
    """
    from pyspark.sql import Window as W

    keys = [key] if isinstance(key, str) else list(key)
    m = F.col(month_col)
    label = F.concat(F.lit("Q"), F.quarter(m).cast("string"), F.lit(" "), F.year(m).cast("string"))
    is_start = F.month(m).isin(1, 4, 7, 10)
    w_all = W.partitionBy(*keys)
    w_prev = W.partitionBy(*keys).orderBy(m).rowsBetween(W.unboundedPreceding, -1)
    out = df.withColumns({
        "_label": label,
        "_n": F.count(F.lit(1)).over(w_all),
        "_last": F.max(m).over(w_all),
    })
    out = out.withColumn(
        "_prev_label", F.last(F.when(is_start, F.col("_label")), ignorenulls=True).over(w_prev)
    )
    tick = (F.when(F.col("_n") <= min_months, F.lit(None))
             .when(is_start, F.col("_label"))
             .when((m == F.col("_last")) &
                   (F.col("_prev_label").isNull() | (F.col("_prev_label") != F.col("_label"))),
                   F.col("_label")))
    return out.withColumn("quarter_label", tick).drop("_label", "_n", "_last", "_prev_label")
