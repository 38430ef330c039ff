"""Helpers shared by the operators of this folder: shared storage, word shingles, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 1_000_000
ARROW_BYTES = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where a local session names none, one is set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="llm-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: the lineage ends
    there, so a lost executor costs a re-read only. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    return out


_PATHS: dict[int, str] = {}


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more, and let the JVM release the
    shuffle files of finished steps."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(id(df)))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, most: int = ARROW_BYTES) -> Iterator[None]:
    """Steps that run inside hand their Python workers rows of about ``most`` bytes at once, one row at least, instead of
    10,000 rows or 64 MB: both the worker's and the JVM's share stay small whatever the texts' length. Results are to be
    ``stored`` inside; the session's own limit comes back at the end."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_batches(texts: Iterable[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, the texts as UTF-8; null is empty) in pieces of about ``limit`` bytes."""
    first, size, out = 0, 0, []
    for i, text in enumerate(texts):
        raw = text.encode() if isinstance(text, str) else b""
        out.append(raw)
        size += len(raw)
        if size >= limit:
            yield first, out
            first, size, out = i + 1, 0, []
    if out:
        yield first, out


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept up to the longest batch seen."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BATCH_BYTES + BATCH_BYTES // 4)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) and the number of each text's."""
    joined = b"\n".join(raws).lower()
    a = np.frombuffer(joined, np.uint8)
    inside = np.concatenate([[0], (~_SPACE[a]).view(np.int8), [0]])
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(a))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * up, dtype=np.uint64)])
    flat = scramble((total[last] - total[first]) * down[first])
    ends = np.cumsum(np.fromiter((len(r) + 1 for r in raws), np.int64, len(raws)))
    return flat, np.diff(np.concatenate([[0], np.searchsorted(first, ends)]))


def shingle_batch(raws: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles in order and the offsets of each text's part. A text of fewer
    words gives its whole sequence; none gives none."""
    flat, counts = word_hashes(raws)
    ends = np.cumsum(counts)
    made = np.maximum(counts - (n - 1), np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    if not len(flat):
        return np.empty(0, np.uint64), offsets
    padded = np.concatenate([flat, np.zeros(n - 1, np.uint64)])
    acc = np.zeros(len(flat), np.uint64)
    for j in range(n):
        acc += (padded[j:j + len(flat)] ^ _MIX[(j + 3) % 8]) * _MIX[j % 8]
    acc = scramble(acc)
    starts = ends - counts
    out = acc[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], made)]
    for i in np.flatnonzero((counts > 0) & (counts < n)):  # the whole sequence as one
        own = flat[starts[i]:ends[i]]
        value = (own ^ _MIX[7]) * _MIX[:len(own)]
        out[offsets[i]] = scramble(np.array([value.sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64))[0]
    return out, offsets


#: Stands for a null id inside Python steps: pandas would turn a column with nulls into doubles.
NO_ID = -(1 << 63)


def no_null(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def null_again(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID)).alias(column)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): ``node, root`` for every node of an edge,
    where root is the smallest node of its component. Alternating large-star and small-star steps;
    each round is written to the shared folder. The number of rounds grows with the logarithm of
    the longest path."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    spark = e.sparkSession

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = state(e)
    if not before[0]:
        return spark.createDataFrame([], "node long, root long")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def without_ids(docs: DataFrame, ids: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """``docs`` whose doc_id is not in ``ids`` (one column doc_id; stored first). The ids are broadcast up
    to ``most_broadcast`` rows, else both sides are shuffled. Rows with null doc_id stay."""
    ids = stored(ids.where("doc_id is not null").distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= most_broadcast else ids, "doc_id", "left_anti").select(*docs.columns)
