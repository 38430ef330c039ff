"""Corpus pipeline: the stages of a training-data clean-up over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. ``run`` writes each stage's rows as Parquet into the shared checkpoint folder and reads
them again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from reelscope.llm.common import read_table, stored, without_ids

KEEP_SCORE = 0.3


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below ``KEEP_SCORE`` go."""
    model = quality.train_quality(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model, to="__quality")
    return scored.where(F.col("__quality") >= KEEP_SCORE).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five words and a similarity of 0.8, the one with the smallest id stays."""
    found = jaccard_join.jaccard_components(docs, jaccard_join.Likeness(5, 80, 100))
    return without_ids(docs, found.where("doc_id <> component_id").select("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 of a benchmark item's five-word shingles go."""
    leaks = decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return without_ids(docs, leaks.select("doc_id"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret span is masked; ``n_chars`` follows the text."""
    scanned = secret_scan.scan_secrets(docs)
    masked = scanned.withColumn("text", secret_scan.mask_spans(F.col("text"), F.col("secret_spans")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as packed token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masking),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
