"""Request-log and system-log storage: S1-S6, S11.

Tables are Parquet folders; the request log is partitioned by ``dt`` (UTC
date), so the time filters of the stats (which emit a ``dt`` predicate) prune
whole partitions. Reads always use the declared schema (never inference):
files written before a column existed read it as NULL (S5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import epoch_date
from ..schemas import LOG, LOG_COLUMNS, LOG_WITH_DT, SYSTEM_LOG
from .ids import IdClaims, with_dense_ids

REQUEST_LOG = "request_log"
SYSTEM_LOG_TABLE = "system_log"


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def create_tables(spark: SparkSession, root: str) -> None:
    """Create both tables (empty, with schema) when missing."""
    log_path = _path(root, REQUEST_LOG)
    if not _exists(spark, log_path):
        spark.createDataFrame([], LOG_WITH_DT).write.partitionBy("dt").parquet(log_path)
    sys_path = _path(root, SYSTEM_LOG_TABLE)
    if not _exists(spark, sys_path):
        spark.createDataFrame([], SYSTEM_LOG).write.parquet(sys_path)


def flatten_usage(df: DataFrame, usage_col: str = "usage") -> DataFrame:
    """S2 projection: a ``usage`` struct becomes the log's token columns; the
    cached count is read from ``prompt_tokens_details['cached_tokens']`` (P12)."""
    if usage_col not in df.columns:
        return df
    u = F.col(usage_col)
    return df.select(
        *[c for c in df.columns if c != usage_col],
        u.getField("prompt_tokens").alias("prompt_tokens"),
        u.getField("completion_tokens").alias("completion_tokens"),
        u.getField("total_tokens").alias("total_tokens"),
        F.try_element_at(u.getField("prompt_tokens_details"), F.lit("cached_tokens")).alias("prompt_cached_tokens"),
        u.getField("cache_creation_input_tokens").alias("cache_creation_input_tokens"),
        u.getField("cache_read_input_tokens").alias("cache_read_input_tokens"),
    )


def claims_of(spark: SparkSession, root: str, table: str) -> IdClaims:
    """The id claims of a table; a table that was filled before there were claims is read once."""
    def taken() -> int:
        if not _exists(spark, _path(root, table)):
            return 0
        return spark.read.schema("id long").parquet(_path(root, table)).agg(F.max("id")).first()[0] or 0
    return IdClaims(spark, _path(root, f"{table}-ids"), taken)


def append_log(df: DataFrame, root: str) -> None:
    """Append request-log rows, partitioned by ``dt``. Rows without an ``id`` get the next ones."""
    df = flatten_usage(df)
    if "id" not in df.columns or df.schema["id"].nullable:
        df = with_dense_ids(df, claims_of(df.sparkSession, root, REQUEST_LOG))
    if "dt" not in df.columns:
        df = df.withColumn("dt", epoch_date(F.col("timestamp")))
    # one file per date, several for a hot one: adaptive execution merges and splits the partitions
    df.select(*LOG_COLUMNS, "dt").hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(_path(root, REQUEST_LOG))


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """S1 + S5: scan with the full declared schema; older files lacking the
    later columns yield NULL for them."""
    return spark.read.schema(LOG_WITH_DT).parquet(_path(root, REQUEST_LOG))


def append_system_log(df: DataFrame, root: str) -> None:
    df.select(*[f.name for f in SYSTEM_LOG.fields]).write.mode("append").parquet(_path(root, SYSTEM_LOG_TABLE))


def read_system_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SYSTEM_LOG).parquet(_path(root, SYSTEM_LOG_TABLE))


QUARANTINE = "system_log_quarantine"


def split_records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, bad lines) of JSON lines (column ``value``). Timestamp, level, name and message
    are required; an ``id`` is not."""
    parsed = lines.select("value", F.from_json("value", SYSTEM_LOG, {"mode": "PERMISSIVE"}).alias("r"))
    good = F.expr("r IS NOT NULL AND r.timestamp IS NOT NULL AND r.level IS NOT NULL AND r.name IS NOT NULL "
                  "AND r.message IS NOT NULL")
    return parsed.filter(good).select("r.*"), parsed.filter(~good).select("value")


def ingest_system_log_json(spark: SparkSession, json_path: str, root: str) -> None:
    """S3: bulk ingest of application log records (JSON lines with timestamp, level, name, message,
    traceback?, id?) into the system log. Records without id get one; lines that are no
    record go to the quarantine table as they are."""
    records, bad = split_records(spark.read.text(json_path).filter("trim(value) <> ''"))
    append_system_log(with_dense_ids(records, claims_of(spark, root, SYSTEM_LOG_TABLE)), root)
    bad.write.mode("append").parquet(_path(root, QUARANTINE))


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("value string").parquet(_path(root, QUARANTINE))


def clear_tables(spark: SparkSession, root: str) -> None:
    """Empty both tables, keeping their schemas."""
    spark.createDataFrame([], LOG_WITH_DT).write.mode("overwrite").partitionBy("dt").parquet(_path(root, REQUEST_LOG))
    spark.createDataFrame([], SYSTEM_LOG).write.mode("overwrite").parquet(_path(root, SYSTEM_LOG_TABLE))


def stats_document(totals_and_models: DataFrame) -> DataFrame:
    """One row -- the totals plus ``model_requests``, an array of per-model
    structs ordered by count desc -- from the single-scan GROUPING SETS result
    (A4). The array holds one entry per model, so it is bounded by the number
    of models, not by the log size."""
    tm = totals_and_models
    measures = [c for c in tm.columns if c not in ("level", "model_id", "requests")]
    is_total = F.col("level") == "total"
    model_struct = F.struct(F.col("model_id"), F.col("requests").alias("count"), *measures)
    one = tm.agg(
        F.first(F.when(is_total, F.struct(F.col("requests").alias("total_requests"), *measures)),
                ignorenulls=True).alias("t"),
        F.array_sort(F.collect_list(F.when(~is_total, F.struct(
            (-F.col("requests")).alias("_k"), F.col("model_id").alias("_m"), model_struct.alias("m"))))).alias("_ms"))
    return one.select("t.*", F.transform("_ms", lambda x: x.getField("m")).alias("model_requests"))


def export_stats_json(totals_and_models: DataFrame, path: str) -> None:
    """Write the stats document as JSON."""
    stats_document(totals_and_models).coalesce(1).write.mode("overwrite").json(path)


def export_models_json(totals_and_models: DataFrame, path: str) -> None:
    """Totals and models as JSON lines, a row each, for logs with any number of (client-chosen) model ids."""
    totals_and_models.write.mode("overwrite").json(path)


def export_series_json(series: dict[str, DataFrame], path: str) -> None:
    """Time series as JSON lines, a folder per period (``period=hour`` ...), ordered by label within."""
    for period, df in series.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/period={period}")


def rows_per_date(log: DataFrame) -> list[tuple]:
    """(dt, rows) of a stored log, newest first, rows without a date last. The scan reads no column, only
    the counts in the files' footers; the result has one row per date of the log."""
    counted = log.groupBy("dt").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("dt").desc_nulls_last())
    return [(r.dt, r.n) for r in counted.collect()]


def stored_page(log: DataFrame, limit: int, offset: int = 0, counts: list[tuple] | None = None) -> DataFrame:
    """L2 on a stored log at any offset: ``counts`` (``rows_per_date``, kept by the caller between pages) tell
    which dates hold the page, and only their partitions are opened; rows of newer dates are
    skipped by their number. Equal to ``views.recent_logs``."""
    lim, skip = (None if limit is None or limit < 0 else int(limit)), max(0, int(offset or 0))
    wanted, left = [], lim
    for dt, n in counts if counts is not None else rows_per_date(log):
        if not wanted and skip >= n:
            skip -= n
            continue
        wanted.append(dt)
        if left is not None:
            left -= n - (skip if len(wanted) == 1 else 0)
            if left <= 0:
                break
    dates = [d for d in wanted if d is not None]
    here = F.col("dt").between(F.lit(min(dates)), F.lit(max(dates))) if dates else F.lit(False)
    here = here | F.col("dt").isNull() if None in wanted else here
    page = log.filter(here).orderBy(F.desc("timestamp"), F.desc("id"))
    page = page.offset(skip) if skip else page
    return page if lim is None else page.limit(lim)


def export_logs_json(page: DataFrame, path: str) -> None:
    """A log page as JSON lines."""
    page.write.mode("overwrite").json(path)


__all__ = ["LOG", "create_tables", "append_log", "read_log", "clear_tables", "ingest_system_log_json",
           "append_system_log", "read_system_log", "export_stats_json", "export_logs_json", "flatten_usage",
           "stats_document"]


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, name: str | None = None) -> str:
    """Write a capture table bucketed (and sorted) by ``key`` at ``path`` and
    register it in the session catalog. Two tables bucketed the same way on
    the join key join without an exchange (co-located sort-merge join)."""
    import uuid
    name = name or f"ledger_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
       .option("path", path).saveAsTable(name))
    return name
