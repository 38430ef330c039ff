"""Quality classifier by compression.

Two zstandard dictionaries are trained from chunks of good and of bad labelled texts. A text is cut into
chunks of ``chunk_bytes`` (all of it, so a long text does not become its own dictionary), every chunk is
compressed with either dictionary, and the normalised difference of the summed sizes,
``(with the bad - with the good) / larger``, becomes a probability by a logistic curve fitted on other
labelled texts than those of the dictionaries, weighted to the label counts of all labelled rows.

Learning takes a bounded sample, whole rows chosen by a hash of their id over all labelled rows:
``sample_docs`` documents and ``sample_chunks`` chunks per class at most. Scoring covers every text.

Null and empty texts have difference 0. Labels of one document that contradict each other are left
out, repeated ones count once, labels without a document or with null are ignored. Without labels of
both classes every text has the share of good labels as its score (0.5 without any). Any columns of
``docs`` are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    intercept: float
    slope: float
    chunk_bytes: int = 1000
    level: int = 3


def _dictionary(samples: list[bytes], size: int) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself serves
        return b"".join(samples)[:size]


def _compressor(data: bytes, level: int):
    import zstandard

    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(data) < 8:
        return zstandard.ZstdCompressor(level=level, **plain)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), level=level, **plain)


def differences(model: QualityModel, texts: Iterator[str | None]) -> Iterator[float]:
    good, bad = _compressor(model.good, model.level), _compressor(model.bad, model.level)
    step = model.chunk_bytes
    for text in texts:
        raw = text.encode() if isinstance(text, str) else b""
        a = b = 0
        for i in range(0, len(raw), step):
            part = raw[i:i + step]
            a += len(good.compress(part))
            b += len(bad.compress(part))
        yield (b - a) / max(a, b, 1)


def difference_udf(model: QualityModel):
    @F.pandas_udf("double")
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(differences(model, texts)), dtype="float64")

    return difference


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", to: str = "quality_score") -> DataFrame:
    """``docs`` with column ``to``: the probability of label 1."""
    x = difference_udf(model)(F.col(text))
    z = F.lit(model.intercept) + F.lit(model.slope) * x
    return docs.withColumn(to, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([np.ones_like(x), x / scale], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (y - p)) - ridge * beta
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = np.clip(beta + step, -30, 30)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def learnable(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 5 is not 0; the others are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0)) != 0


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = 4000,
                  sample_chunks: int = 4000, dictionary_bytes: int = 110_000, chunk_bytes: int = 1000,
                  level: int = 3) -> QualityModel:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("__top")).where("label = __top")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    share = totals.get(1, 0) / max(sum(totals.values()), 1) if totals else 0.5
    if len(totals) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", float(np.log(share / (1 - share))), 0.0, chunk_bytes, level)
    key = F.xxhash64("doc_id", F.lit("sample"))
    ids = known.where("label = 0").orderBy(key).limit(sample_docs).unionByName(
        known.where("label = 1").orderBy(key).limit(sample_docs)).select("doc_id", "label")
    # at most 2 * sample_docs ids: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "label", "text", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)).alias("part"))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for lab, text in zip(batch["label"], batch["text"], strict=True):
                raw = text.encode() if isinstance(text, str) else b""
                for i in range(0, len(raw), chunk_bytes):
                    part = raw[i:i + chunk_bytes]
                    out.append((int(lab), xxhash.xxh3_64_intdigest(part) >> 1, part))
            yield pd.DataFrame(out, columns=["label", "rank", "chunk"])

    cut = rows.where("part = 0").select("label", "text").mapInPandas(chunks, "label int, rank long, chunk binary").distinct()
    some = {c: [bytes(r["chunk"]) for r in cut.where(F.col("label") == c).orderBy("rank").limit(sample_chunks).collect()]
            for c in (0, 1)}
    model = QualityModel(_dictionary(some[1], dictionary_bytes), _dictionary(some[0], dictionary_bytes), 0.0, 1.0,
                         chunk_bytes, level)
    fit = rows.where("part = 1").select("label", difference_udf(model)(F.col("text")).alias("x")).limit(2 * sample_docs)
    got = [(r["label"], r["x"]) for r in fit.collect()]
    y, x = np.array([g[0] for g in got], float), np.array([g[1] for g in got], float)
    if len(set(y)) < 2:
        return QualityModel(model.good, model.bad, float(np.log(share / (1 - share))), 0.0, chunk_bytes, level)
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    intercept, slope = _logistic(x, y, w)
    return QualityModel(model.good, model.bad, intercept, slope, chunk_bytes, level)
