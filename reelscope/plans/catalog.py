"""Registry of checked queries: one Spark query and one DuckDB oracle per operator ID.

A query takes ``(spark, sf_dir)`` and returns a DataFrame; ``finish`` renders it for the
comparison (doubles rounded to 6 digits, integers as bigint, dates and timestamps as ISO
text). The oracle is DuckDB SQL over the driver's views; ``oracle(...)`` wraps it with the
same rendering for the columns it names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelscope.plans import views as V

STAMP_FMT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAMP_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"


@dataclass
class Case:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doc: str = ""
    tags: list[str] = field(default_factory=list)


def r6_sql(expr: str) -> str:
    return f"round(({expr}) * 1e6) / 1e6"


def finish(df: DataFrame) -> DataFrame:
    """Render a result for comparison; column names are kept."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, STAMP_FMT_SPARK)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6)
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def oracle(sql: str, views: list[str], doubles: tuple[str, ...] = (), stamps: tuple[str, ...] = (),
           dates: tuple[str, ...] = ()) -> str:
    """Wrap ``sql`` (which may use the named views) with the rendering of ``finish``."""
    repl = [f"{r6_sql(f'CAST({c} AS DOUBLE)')} AS {c}" for c in doubles]
    repl += [f"strftime({c}, '{STAMP_FMT_SQL}') AS {c}" for c in stamps]
    repl += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates]
    body = f"SELECT * REPLACE ({', '.join(repl)}) FROM ({sql}) q" if repl else f"SELECT * FROM ({sql}) q"
    return V.with_views(body, *views) if views else body


REGISTRY: dict[str, Case] = {}


def register(name: str, sql: str | None = None, doc: str = ""):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        REGISTRY[name] = Case(name, fn, sql, doc or (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Case]:
    # importing the case modules fills REGISTRY
    from reelscope.plans import (  # noqa: F401
        cases_disconnect,
        cases_functions,
        cases_reshape,
        cases_sentiment,
        cases_timeline,
        cases_profile,
        cases_topics,
        cases_pages,
        cases_inventory,
    )
    return REGISTRY
