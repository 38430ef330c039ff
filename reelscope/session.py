"""Session and lineage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Broadcast a side only below this many rows, after counting it.
BROADCAST_MAX_ROWS = 2_000_000


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "reelscope",
              driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster, build the session with the
    cluster's own settings instead; nothing in the library depends on these values."""
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give a CPU-heavy scan at least one partition per core.

    A small file with one parquet row group is read by one task however many splits it
    has, so text work on it runs on one core. When the scan has fewer partitions than the
    cluster's default parallelism, rows are spread round-robin (a sort-based, repeatable
    repartition); a large scan already has more splits than cores and is returned as is,
    so no shuffle is added at scale."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a scratch folder; on a cluster it is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="reelscope-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage, so a lost
    executor recomputes from the checkpoint instead of the whole plan (never a
    machine-local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
