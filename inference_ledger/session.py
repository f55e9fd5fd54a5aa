"""Session helpers: building a session for tests/bench, the shared checkpoint
folder, and size-checked broadcasting."""

from __future__ import annotations

import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dimension tables (backends, model mappings, untracked ids) are broadcast only behind a bound
# that holds: literal rows, whose number the planner knows, or a table written once and measured
# (``measured_broadcast``). Estimates of derived plans are not believed: an explode or an
# aggregate may be far larger than its estimate. All other sides get no hint, and
# adaptive execution decides by the sizes it has measured after their shuffle.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
BROADCAST_MAX_ROWS = 50_000


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "inference-ledger") -> SparkSession:
    """Session used by tests and the bench. On a cluster, pass no master and let
    spark-submit decide; every setting here is a plain Spark conf."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEDGER_DRIVER_MEMORY", "16g"))
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, stream state and written tables.

    Read from the session (``spark.checkpoint.dir`` or the SparkContext's
    checkpoint dir). When neither is set, a local run (tests) gets a fresh scratch
    folder, and any other master an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledger-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of queries that are over. Its cleaner does so when the driver collects garbage,
    which may be long after a step has written its result; called between the written steps of an operator,
    so that their shuffles do not lie on the disks side by side."""
    for _ in range(2):          # the second finds what the first has left to be finished
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def literal_bytes(df: DataFrame) -> int | None:
    """Size of a plan that is literal rows (rows times row width), else None."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() != "LocalRelation":
        return None
    return int(str(plan.stats().sizeInBytes()))


def is_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """True only for literal rows of at most ``max_bytes``."""
    size = literal_bytes(df)
    return size is not None and size <= max_bytes


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint for literal rows of proven size; anything else is returned without a hint."""
    return F.broadcast(df) if is_small(df, max_bytes) else df


def measured_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``df`` written once to the shared folder and read back; broadcast if the written table has at
    most ``max_rows`` rows (``BROADCAST_MAX_ROWS``) and a quarter of ``max_bytes`` on disk."""
    if is_small(df, max_bytes):
        return F.broadcast(df)
    spark = df.sparkSession
    folder = scratch_path(spark, "dimension")
    df.write.parquet(folder)
    written = spark.read.schema(df.schema).parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path)
    if files.getLength() <= max_bytes // 4 and written.count() <= (max_rows or BROADCAST_MAX_ROWS):
        return F.broadcast(written)
    return written


def spread(df: DataFrame, min_partitions: int | None = None, key: str | None = None) -> DataFrame:
    """Spread CPU-heavy per-row work (JSON parsing, regex) over the cluster
    when the input has fewer splits than cores (e.g. one large row group).
    Large inputs already have many more splits than cores and are returned
    untouched, so no shuffle is added at scale. Filters and column pruning
    still reach the scan below the repartition. With ``key`` the rows are
    hash-partitioned on it, so a later join or aggregation on that key (with
    the same partition count) reuses the partitioning instead of shuffling
    again."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)
