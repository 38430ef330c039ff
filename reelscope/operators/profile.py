"""Data-quality reports (A12-A17, N17 of the survey).

Each report is one aggregation over the table, read once (the reference makes a pass per column
and statistic).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.functions.dates import is_missing_token
from reelscope.functions.text import preview


def _cells(df: DataFrame, order: str | None = None) -> DataFrame:
    """One row per cell: the column's place, its value as text and the row's ``order``."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("value"))
                      for i, c in enumerate(df.columns)])
    at = F.col(order).alias("_at") if order else F.lit(None).cast("long").alias("_at")
    return df.select(at, F.explode(cells).alias("_c")).select("_at", "_c.i", "_c.value")


def column_profile(df: DataFrame, order: str, n_sample: int = 30) -> DataFrame:
    """Per column its type, nulls, null %, distinct non-null values and a sample (the
    first non-null value in ``order``, cut to 30 characters); plus a ``*`` row with the
    total nulls and their share of all cells. Distinct counts are exact, of the values as text.

    The table is read once, as cells: equal values of a column meet in the tasks first, with their count and least
    ``order``, then one row per column is left. An empty table gives no rows."""
    values = _cells(df, order).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("at"))
    there = F.col("value").isNotNull()
    per = values.groupBy("i").agg(
        F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min_by(F.substring("value", 1, n_sample + 1), F.when(there, F.col("at"))).alias("sample"))
    # one row per column of the table from here on
    whole = F.explode(F.array(F.lit(False), F.lit(True)))
    both = per.withColumn("_all", whole).groupBy(F.when(~F.col("_all"), F.col("i")).alias("i")).agg(
        F.max("total_rows").alias("total_rows"), F.sum("null_count").alias("null_count"),
        F.count(F.lit(1)).alias("_cols"), F.max("distinct_count").alias("distinct_count"), F.max("sample").alias("sample"))
    one = F.col("i").isNotNull()
    names = F.array(*[F.lit(c) for c in df.columns])
    types = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema.fields])
    return both.select(
        "total_rows", F.when(one, names[F.col("i")]).otherwise(F.lit("*")).alias("column_name"),
        F.when(one, types[F.col("i")]).alias("data_type"), "null_count",
        F.when(one, F.col("distinct_count")).alias("distinct_count"),
        F.when(one, preview(F.col("sample"), n_sample)).alias("sample"),
        F.try_divide(F.col("null_count") * F.lit(100.0), F.col("total_rows") * F.col("_cols")).alias("null_percentage"))


def column_sketches(df: DataFrame, lg_k: int = 12) -> DataFrame:
    """A12 for a batch: per column its rows, nulls and a distinct-count sketch of fixed size, to be stored
    and merged with other batches (``merge_sketches``) without reading them again."""
    names = F.array(*[F.lit(c) for c in df.columns])
    return _cells(df).groupBy(names[F.col("i")].alias("column_name")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("value").isNull()).alias("null_count"),
        F.hll_sketch_agg("value", F.lit(lg_k)).alias("distinct_sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """The profile of all batches whose ``column_sketches`` rows are given: the distinct count is an estimate (standard
    error about 1.04 / sqrt(2 ** lg_k), 1.6 % by default), rows and nulls are exact."""
    return sketches.groupBy("column_name").agg(
        F.sum("total_rows").alias("total_rows"), F.sum("null_count").alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_estimate"))


def movie_source_table(df: DataFrame, movie: str = "movie_name", source: str = "source",
                       text: str = "review_text", rating: str = "rating") -> DataFrame:
    """Per movie the total, IMDb / Letterboxd / Rotten Tomatoes counts, text nulls and
    rating nulls (one aggregate with conditional counts instead of a pivot)."""
    return df.groupBy(movie).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(F.col(source) == "imdb").alias("imdb"),
        F.count_if(F.col(source) == "ltbx").alias("ltbx"),
        F.count_if(F.col(source) == "rt").alias("rt"),
        F.count_if(F.col(text).isNull()).alias("review_text_nulls"),
        F.count_if(F.col(rating).isNull()).alias("rating_nulls"))


def high_null_flag(table: DataFrame, pct: float = 10.0) -> DataFrame:
    """Text-null and rating-null shares per movie and whether either exceeds ``pct``."""
    t = F.col("total_reviews").cast("double")
    out = table.withColumns({
        "review_text_null_pct": F.when(t > 0, F.col("review_text_nulls") / t * 100.0).otherwise(F.lit(0.0)),
        "rating_null_pct": F.when(t > 0, F.col("rating_nulls") / t * 100.0).otherwise(F.lit(0.0)),
    })
    return out.withColumn("high_nulls", (F.col("review_text_null_pct") > pct) | (F.col("rating_null_pct") > pct))


def grand_totals(table: DataFrame) -> DataFrame:
    """Totals over movies, each as % of all reviews, and the number of movies."""
    sums = table.agg(F.count(F.lit(1)).alias("movies"),
                     *[F.sum(c).alias(c) for c in ("total_reviews", "imdb", "ltbx", "rt",
                                                   "review_text_nulls", "rating_nulls")])
    tot = F.col("total_reviews").cast("double")
    return sums.withColumns({f"{c}_pct": F.try_divide(F.col(c) * F.lit(100.0), tot)
                             for c in ("imdb", "ltbx", "rt", "review_text_nulls", "rating_nulls")})


def combined_profile(df: DataFrame, movie: str = "movie_name", rating: str = "rating",
                     source: str = "source") -> DataFrame:
    """Per movie rating mean, min, max, sample standard deviation and source shares."""
    n = F.count(F.lit(1))
    return df.groupBy(movie).agg(
        n.alias("reviews"), F.avg(rating).alias("rating_mean"), F.min(rating).alias("rating_min"),
        F.max(rating).alias("rating_max"), F.stddev_samp(rating).alias("rating_std"),
        *[(F.count_if(F.col(source) == s) / n * F.lit(100.0)).alias(f"{s}_share") for s in ("imdb", "ltbx", "rt")])


def date_quality(df: DataFrame, raw: str, parsed: str, by: Sequence[str]) -> DataFrame:
    """Null dates before parsing (missing tokens) and after, their shares and the
    number of dates the parser could not read, in one pass."""
    n = F.count(F.lit(1))
    before = F.count_if(is_missing_token(raw))
    after = F.count_if(F.col(parsed).isNull())
    return df.groupBy(*by).agg(
        n.alias("rows"), before.alias("nulls_before"), (before / n * F.lit(100.0)).alias("null_pct_before"),
        after.alias("nulls_after"), (after / n * F.lit(100.0)).alias("null_pct_after"),
        (after - before).alias("unparsed"))


def schema_report(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Column -> type per table, to spot drift between files of one source. Reads
    schemas only (no data): a small table built on the driver from metadata."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string")
