"""Scans and sinks (S1-S9 of the survey).

Reads are ``spark.read`` with an explicit schema (never inferred): every raw column is a
string and is cast later with ``try_cast``. Writes are the DataFrame writers; none
coalesces to one file, so a write is as parallel as the data it writes. CSV is written
with doubled quotes (as pandas writes it) and is read back with ``multiLine``.
"""

from __future__ import annotations

import csv
import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.functions.text import slug

# The column lists of the three sites' CSV files (RT in two forms).
SITE_COLUMNS = {
    "imdb": ["Username", "Date", "Title", "Review Text", "Rating"],
    "ltbx": ["username", "rating", "review_text", "date", "likes", "comments", "viewing_type", "user_liked"],
    "rt_a": ["Type", "Filter", "Review Content", "Name", "Date", "Rating", "Source Filter"],
    "rt_b": ["Type", "Filter", "Review Content", "Name", "Date", "Rating", "Verified", "Publication",
             "Source Filter"],
}
SENTIMENT_COLUMNS = ["sentiment", "sentiment_label", "sentiment_score", "positive", "negative", "neutral"]


def site_schema(site: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in SITE_COLUMNS[site]])


def _csv(spark: SparkSession, schema: T.StructType | None = None, multi_line: bool = True):
    r = (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"')
         .option("escape", '"').option("encoding", "UTF-8").option("mode", "PERMISSIVE"))
    return r.schema(schema) if schema is not None else r


def movie_from_folder(path: Column) -> Column:
    """The folder a file sits in, as the movie name (``.../Felix Manalo/imdb.csv``)."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def read_reviews(spark: SparkSession, paths: str | Sequence[str], site: str, batch_rank: int = 0,
                 multi_line: bool = True) -> DataFrame:
    """One site's review CSVs (header, BOM, quoted text over several lines, doubled
    quotes). Adds ``movie_name`` from the folder and the order key ``_order`` =
    (batch, file, row in file) that keep-first de-duplication needs (U1).

    ``monotonically_increasing_id`` right after the scan follows the row order of a file. A multi-line CSV file is
    not split, so one task reads it; files without line breaks inside texts can be read with ``multi_line=False``, which
    splits a large file (its parts are read in file order, so the order key holds)."""
    df = _csv(spark, site_schema(site), multi_line).csv(list(paths) if not isinstance(paths, str) else paths)
    path = F.col("_metadata.file_path")
    return df.withColumns({
        "movie_name": F.url_decode(movie_from_folder(path)),
        "_order": F.struct(F.lit(batch_rank).alias("batch"), path.alias("file"),
                           F.monotonically_increasing_id().alias("row")),
    })


def read_rt(spark: SparkSession, form_a: Sequence[str], form_b: Sequence[str]) -> DataFrame:
    """S1 for Rotten Tomatoes: the two file forms read with their own schema and merged
    by name (form A has no ``Verified`` / ``Publication``)."""
    parts = [read_reviews(spark, p, s) for p, s in ((form_a, "rt_a"), (form_b, "rt_b")) if p]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def movie_from_path(c) -> Column:
    """S3: file base name minus ``_reviews_sentiment.csv`` / ``_reviews.csv`` / ``.csv``,
    ``_`` -> space, each word capitalised (``initcap``: a letter after a digit or a
    hyphen stays lower case, where Python's ``title`` would raise it)."""
    base = F.regexp_extract(F.col(c) if isinstance(c, str) else c, "([^/]+)$", 1)
    stem = F.regexp_replace(base, "(_reviews_sentiment\\.csv|_reviews\\.csv|\\.csv)$", "")
    return F.initcap(F.translate(stem, "_", " "))


def read_scored(spark: SparkSession, folder: str, names: Sequence[str] = (),
                pattern: str = "*sentiment*.csv") -> DataFrame:
    """The scored-sentence CSVs of a folder: every file matching ``pattern`` plus the
    listed ``names`` (those that exist); ``movie`` from the file name (S3).

    Columns are strings, matched by header name: only the header line of each file is read on
    the driver, files with the same header are one scan with that schema, and the scans are
    merged by name (a column that a file lacks is null). Empty files give no row; a folder
    without any file gives an empty table with the column ``movie``."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(base) if s.isFile()
             and (fnmatch.fnmatch(s.getPath().getName(), pattern) or s.getPath().getName() in set(names))]
    layouts: dict[tuple[str, ...], list[str]] = {}
    for path in sorted(found, key=lambda p: p.getName()):
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(path), "UTF-8"))
        head = lines.readLine()
        lines.close()
        if head:
            layouts.setdefault(tuple(next(csv.reader([head.lstrip("﻿")]))), []).append(path.toString())
    parts = []
    for columns, paths in layouts.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        parts.append(_csv(spark, schema).csv(paths)
                     .withColumn("movie", movie_from_path(F.url_decode("_metadata.file_name"))))
    if not parts:
        return spark.createDataFrame([], "movie string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def has_sentiment(df: DataFrame, columns: Sequence[str] = SENTIMENT_COLUMNS) -> bool:
    """Schema probe, no data read: is any of the sentiment columns present?"""
    return bool(set(df.columns) & set(columns))


def write_per_movie(df: DataFrame, path: str, movie: str = "movie_name", mode: str = "overwrite") -> None:
    """One folder of CSV parts per movie (``movie_slug=<slug>``), so that a later
    read of one movie prunes the others."""
    (df.withColumn("movie_slug", slug(F.col(movie))).write.mode(mode).partitionBy("movie_slug")
       .option("header", True).option("escape", '"').csv(path))


COMBINED_ORDER = ["movie_name", "username", "date", "review_text", "rating", "source"]


def write_combined(df: DataFrame, path: str, order: Sequence[str] = COMBINED_ORDER, mode: str = "overwrite") -> None:
    """All movies in one CSV dataset, fixed column order."""
    df.select(*order).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_summary_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per row; struct and map columns stay nested."""
    df.write.mode(mode).json(path)


def _csv_ready(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text (CSV cannot hold them)."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_result_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """Each result table as a CSV dataset ``<folder>/<name>``."""
    for name, df in tables.items():
        _csv_ready(df).write.mode(mode).option("header", True).option("escape", '"').csv(
            f"{folder.rstrip('/')}/{name}")


def json_lines(df: DataFrame, out: str = "value") -> DataFrame:
    """S7 as text: one JSON record per row (column ``out``), nested columns kept, null fields written out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias(out))


CORRUPT = "_corrupt_record"


def read_json_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The records of ``json_lines`` under a declared schema; text that is no such record gives nulls and stays in
    ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return lines.select(F.from_json(F.col(value), full, options).alias("_r")).select("_r.*")


# quotes inside a text are doubled; a null and an empty text are both read as null, as CSV does not tell them apart
CSV_TEXT = {"escape": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1"}


def csv_lines(df: DataFrame, order: Sequence[str] | None = None, out: str = "value") -> DataFrame:
    """S5, S6, S8 as text: one CSV record per row in column ``order``; arrays, maps and structs as JSON text. A record
    with line breaks in a quoted field is still one row here."""
    flat = _csv_ready(df.select(*order) if order else df)
    return flat.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in flat.columns]),
                                {**CSV_TEXT, "quoteAll": "false"}).alias(out))


def read_csv_lines(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """The records of ``csv_lines`` under a declared schema; broken records stay in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {**CSV_TEXT, "emptyValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    return lines.select(F.from_csv(F.col(value), full.toDDL(), options).alias("_r")).select("_r.*")


def save_topic_model(model, path: str) -> None:
    """Persist a fitted Spark ML model or pipeline."""
    model.write().overwrite().save(path)


def load_topic_model(path: str):
    """Load what ``save_topic_model`` wrote (a ``PipelineModel``)."""
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
