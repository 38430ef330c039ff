"""Order-dependent numbering that scales with skewed groups.

``row_number() over (partition by key order by ...)`` sends a whole group to one task; with
a group holding a third of the rows that task holds a third of the data. ``ordered_index``
gives the same numbers by prefix sums over buckets of the order column: a row's number is its place in its
bucket plus the rows of the buckets before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 12
STEP_BITS = 20


def _as_long(df: DataFrame, name: str) -> Column:
    """A long that rises with the column, nulls first."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        value = c.cast("long")
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        value = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        value = F.unix_date(c).cast("long")
    elif isinstance(kind, T.StringType):  # the first seven bytes
        value = F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    else:
        raise TypeError(f"cannot number by {name}: {kind.simpleString()}")
    return F.coalesce(value, F.lit(-(1 << 63)))


def _null_safe(df: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """Left columns and the columns ``other`` adds, joined on equal ``names`` (nulls equal)."""
    renamed = other.select(*[F.col(c).alias(f"__{c}" if c in names else c) for c in other.columns])
    on = reduce(lambda x, y: x & y, [df[c].eqNullSafe(renamed[f"__{c}"]) for c in names])
    return df.join(renamed, on).drop(*[f"__{c}" for c in names])


def ordered_index(df: DataFrame, keys: list[str], order: list[str], out: str = "idx",
                  bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """0-based position of each row inside its ``keys`` group, in ``order`` (ascending, nulls first).

    ``order`` must be a total order inside a group (add a unique column as the last
    tie-break); its first column is a whole number, a date, a time stamp or a text. A bucket is
    ``2 ** bucket_bits`` successive values of it (texts: of their first seven bytes). Rows are counted per (key, bucket) before any
    shuffle; the running sums go up in steps of ``STEP_BITS`` bits, so no window holds more than ``2 ** STEP_BITS``
    counts however sparse the values are. The rows are shuffled once, by (key, bucket). Nothing runs when
    the query is built and nothing is written: the numbers are a pure function of the rows.
    """
    rows = df.withColumn("_b0", F.shiftright(_as_long(df, order[0]), bucket_bits))
    levels = [rows.groupBy(*keys, "_b0").agg(F.count(F.lit(1)).alias("_n"))]
    top = -(-(64 - bucket_bits) // STEP_BITS)  # how often the buckets are gathered until a key has few
    for level in range(1, top):
        finer = levels[-1].withColumn(f"_b{level}", F.shiftright(f"_b{level - 1}", STEP_BITS))
        levels.append(finer.groupBy(*keys, f"_b{level}").agg(F.sum("_n").alias("_n")))
    before = None
    for level in reversed(range(top)):
        own = levels[level].withColumn(f"_b{level + 1}", F.shiftright(f"_b{level}", STEP_BITS))
        within = [*keys, f"_b{level + 1}"] if level + 1 < top else keys
        w = Window.partitionBy(*within).orderBy(f"_b{level}").rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn("_sum", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
        if before is not None:
            own = _null_safe(own, before, [*keys, f"_b{level + 1}"]).withColumn("_sum", F.col("_sum") + F.col("_before"))
        before = own.select(*keys, f"_b{level}", F.col("_sum").alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_b0").orderBy(*order)) - 1
    placed = _null_safe(rows.withColumn("_place", place), before, [*keys, "_b0"])
    return placed.withColumn(out, (F.col("_before") + F.col("_place")).cast("long")).drop("_b0", "_place", "_before")


def with_rank(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """1-based place of every row in the whole table in ``order`` (ascending, nulls first; a total order that starts with a
    whole number, date or text), numbered by ``ordered_index``, so no window holds the whole table."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({"_all": F.lit(0), **dict(zip(names, order))})
    return ordered_index(keyed, ["_all"], names, out=out).withColumn(out, F.col(out) + 1).drop("_all", *names)
