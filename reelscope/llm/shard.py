"""Sharding by rendezvous hashing of a stable record key over weighted shards.

Every (key, shard) has a uniform number u from a 64-bit hash; the record goes to the shard with the
largest ``weight / -ln(u)``. A shard's share is its weight's; one more shard takes records only into
itself, one less gives up only its own. Ties go to the smaller shard number.

Rows with a null key form one key. Rows with equal key, size and checksum are interchangeable: they are
counted before the shuffle and get their places as one run, so a key with a third of all rows is one
row until the result is written out. Empty input gives an empty result. Places are gapless per shard:
each shard is cut into ``buckets`` by a second hash; places count within a bucket and are moved by the
running number of rows in the buckets before it (at most shards x buckets rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _score(key: list[Column], shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(*key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.lit(float(weight)) / -F.log(u)


def rendezvous(key: list[Column], weights: list[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a key. Weights must be positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = F.array(*[_score(key, i, w) for i, w in enumerate(weights)])
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def with_slots(rows: DataFrame, shard: str, order: list[str], buckets: int = 256) -> DataFrame:
    """One output row per input row with ``slot``: 0, 1, 2 ... within each ``shard``, in no special
    order. ``order`` must name all columns besides ``shard``: equal rows are interchangeable."""
    bucket = F.pmod(F.xxhash64(*order, F.lit("bucket")), F.lit(buckets)).cast("int")
    runs = rows.groupBy(shard, *order).agg(F.count("*").alias("__n")).withColumn("__bucket", bucket)
    inside = Window.partitionBy(shard, "__bucket").orderBy(*order)
    placed = runs.withColumn("__end", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy(shard, "__bucket").agg(F.sum("__n").alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))).drop("__rows")
    # at most shards x buckets rows, whatever the input
    joined = placed.join(F.broadcast(offsets), [shard, "__bucket"])
    first = F.col("__before") + F.col("__end") - F.col("__n")
    return joined.select(shard, *order, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, weights: list[float] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, grown_shard, slot`` for every row; ``grown_shard`` is the
    shard when one more, of the mean weight, is there. Null text: size 16, checksum of the empty text."""
    weights = weights or [1.0] * shards
    key = [F.col("doc_id")]
    grown = [*weights, sum(weights) / len(weights)]
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"),
                       F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", F.array(*[_score(key, i, w) for i, w in enumerate(grown)]).alias("__s"))
    old = F.slice("__s", 1, len(weights))
    rows = rows.select("doc_id", "size", "text_crc32",
                       (F.array_position(old, F.array_max(old)) - 1).cast("int").alias("shard"),
                       (F.array_position("__s", F.array_max("__s")) - 1).cast("int").alias("grown_shard"))
    return with_slots(rows, "shard", ["doc_id", "size", "text_crc32", "grown_shard"])
