"""Projections, filters, unions, de-duplication and small joins
(P1-P11, U1-U8, J4, J5 of the survey).

Order-dependent rules ("keep the first", "first non-null") use an explicit order key
taken right after the scan, never the physical row order, and are computed with
``min_by`` aggregates (partial aggregation, no sort) instead of ``dropDuplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelscope.functions.text import strip_ws


# ------------------------------------------------------------------ P: projections and filters

def project(df: DataFrame, mapping: dict[str, str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Rename (old -> new) and put columns in ``order``."""
    out = df.withColumnsRenamed(mapping) if mapping else df
    return out.select(*order) if order else out


def drop_empty_text(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose text is null or only whitespace (tabs and newlines too)."""
    return df.filter(strip_ws(F.coalesce(F.col(col).cast("string"), F.lit(""))) != "")


def filter_movie(df: DataFrame, name: str, col: str = "movie_name") -> DataFrame:
    """One movie (an equality filter, pushed down to the scan)."""
    return df.filter(F.col(col) == F.lit(name))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols``."""
    return df.dropna(subset=list(cols))


def null_rows(df: DataFrame, col: str, show: Sequence[str], order: Sequence[str], n: int | None = None) -> DataFrame:
    """P5: rows where ``col`` is null, with a few columns; ``n`` rows for display."""
    out = df.filter(F.col(col).isNull()).select(*show)
    out = out.orderBy(*order)
    return out.limit(n) if n else out


TEXT_CANDIDATES = ["sentence", "review_text", "text", "content"]
LABEL_CANDIDATES = ["sentiment", "sentiment_label"]
RATING_CANDIDATES = ["rating", "user_rating"]
DATE_CANDIDATES = ["date", "review_date"]


def first_present_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first candidate that is a column (a schema-time choice); error listing the
    columns when none is."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} in columns {df.columns}")


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Input contract."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; have {df.columns}")
    return df


def add_movie(df: DataFrame, name: str, col: str = "movie_name") -> DataFrame:
    """A literal movie column in front."""
    return df.select(F.lit(name).alias(col), *[c for c in df.columns if c != col])


def tag_source(df: DataFrame, source: str, col: str = "source") -> DataFrame:
    """A literal source column."""
    return df.withColumn(col, F.lit(source))


def min_docs_gate(df: DataFrame, keys: Sequence[str], n: int = 10) -> DataFrame:
    """Keep groups with at least ``n`` rows (fewer are skipped by topic work).
    The counts are a partial aggregate; the semi join's right side has one row per group."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).drop("_n")
    return df.join(big, list(keys), "left_semi")


def head(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """P10: first ``n`` rows in a total order (a top-n, planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def rescore_mode(df: DataFrame, mode: int, scorer: Callable[[DataFrame], DataFrame],
                 label: str = "sentiment", text: str = "text") -> DataFrame:
    """Which rows get scored. 1 = none (reuse labels), 2 = all, 3 = only rows without
    a label; any other value means 1. ``scorer`` adds the score columns to a DataFrame.

    Mode 3 reads its rows once: a labelled row goes to the scorer with a null ``text``, which is not scored (F3), and
    gets its own label, scores and text back."""
    old = [c for c in df.columns if c in SCORE_COLUMNS]
    if mode == 2:
        return scorer(df.drop(*old))
    if mode != 3:
        return df
    if label not in df.columns:
        return scorer(df)
    done = F.col("_label").isNotNull()
    kept = df.withColumns({"_label": F.col(label), "_text": F.col(text)}).withColumnsRenamed({c: f"_was_{c}" for c in old})
    scored = scorer(kept.withColumn(text, F.when(~done, F.col(text))))
    new = [c for c in scored.columns if c in SCORE_COLUMNS]
    out = scored.withColumns({c: F.when(done, F.col(f"_was_{c}") if c in old else F.lit(None)).otherwise(F.col(c)) for c in new})
    return out.withColumns({text: F.col("_text"), label: F.coalesce(F.col("_label"), F.col(label))}) \
              .select(*df.columns, *[c for c in new if c not in df.columns])


SCORE_COLUMNS = ["sentiment", "confidence", "prob_negative", "prob_neutral", "prob_positive"]


# ------------------------------------------------------------------ U: unions and de-duplication

def with_order_key(df: DataFrame, batch_rank: int, col: str = "_order") -> DataFrame:
    """Order key for keep-first rules: (batch rank, row id taken right after the scan).
    A multi-line CSV file is read as one split, so ids follow the file."""
    return df.withColumn(col, F.struct(F.lit(batch_rank).alias("batch"),
                                       F.monotonically_increasing_id().alias("row")))


def union_batches(earliest: DataFrame, latest: DataFrame, col: str = "_order") -> DataFrame:
    """UNION ALL of two pulls, earliest first; the order key decides which duplicate
    survives a later keep-first."""
    a = earliest if col in earliest.columns else with_order_key(earliest, 0, col)
    b = latest if col in latest.columns else with_order_key(latest, 1, col)
    return a.unionByName(b, allowMissingColumns=True)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name of any number of parts; empty parts are fine."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def check_union_rows(parts: Sequence[DataFrame], whole: DataFrame) -> DataFrame:
    """One row: sum of the parts' counts, the union's count and whether they agree
    (all counts in one job)."""
    counts = [p.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(i)) for i, p in enumerate(parts)]
    total = whole.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(-1))
    allc = union_all([*counts, total])
    return allc.agg(F.sum(F.when(F.col("k") >= 0, F.col("n"))).alias("parts_rows"),
                    F.max(F.when(F.col("k") < 0, F.col("n"))).alias("union_rows")) \
               .withColumn("equal", F.col("parts_rows") == F.col("union_rows"))


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The first row (smallest ``order``) of each key; nulls in keys count as equal.

    One ``groupBy`` with ``min_by(struct(row), order)``: map-side partial aggregation keeps
    one candidate per key per task, so a key with a third of all rows costs no more than
    any other key. (``dropDuplicates`` keeps an arbitrary row.)"""
    order_col = F.col(order) if isinstance(order, str) else order
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in others]), order_col).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*df.columns)


def unique_reviews(df: DataFrame, filter_col: str, name: str, date: str, text: str,
                   order: str | Column) -> DataFrame:
    """The first row of each review. Two rows are the same review when filter, name, date
    and the whole text are equal (nulls count as equal)."""
    return dedup_keep_first(df, [filter_col, name, date, text], order)


def cap_per_group(df: DataFrame, group: Sequence[str], n: int, order: Sequence) -> DataFrame:
    """U8: at most ``n`` rows per group, first by ``order``. ``row_number() <= n`` with a
    small ``n`` is planned with a partial WindowGroupLimit before the shuffle, so each
    task forwards at most ``n`` rows per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


# ------------------------------------------------------------------ J: calendar and lookups

def densify_months(series: DataFrame, keys: Sequence[str], month: str = "month",
                   counts: Sequence[str] = ("count",), means: Sequence[str] = ()) -> DataFrame:
    """Every month between a group's first and last month; counts filled with 0, means
    left null. The calendar is generated per group from its min/max (one row per group
    and month), then left-joined to the series on (group, month)."""
    keys = list(keys)
    bounds = series.groupBy(*keys).agg(F.min(month).alias("_lo"), F.max(month).alias("_hi"))
    cal = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias(month))
    out = cal.join(series, [*keys, month], "left")
    for c in counts:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out.select(*keys, month, *counts, *means)


def lookup(col, mapping: dict, default=None) -> Column:
    """Value lookup in a small literal dictionary, with a default."""
    c = F.col(col) if isinstance(col, str) else col
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    got = F.try_element_at(m, c)
    return F.coalesce(got, F.lit(default)) if default is not None else got


def explode_list(df: DataFrame, values: Column, keep: Sequence[str], out: str, pos: str | None = None,
                 keep_empty: bool = False) -> DataFrame:
    """One row per element of the list ``values`` with the columns ``keep`` (and the element's position from 0);
    ``keep_empty`` keeps a row with an empty or null list as one row of nulls.

    The list is a column below an outer generator, so it is computed once a row: under an inner generator Spark infers
    the filter ``size(values) > 0``, which computes the whole list again for every mention in its expression."""
    at = pos or "_pos"
    rows = df.select(*keep, values.alias("_list")).select(*keep, F.posexplode_outer("_list").alias(at, out))
    rows = rows if keep_empty else rows.filter(F.col(at).isNotNull())
    return rows if pos else rows.drop(at)
