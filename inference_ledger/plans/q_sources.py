"""Registered storage / export queries: S1-S6, S11 (write, then read back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, views
from ..schemas import LOG, LOG_COLUMNS, LOG_V1, SYSTEM_LOG
from ..session import scratch_path
from ..sources import derive, logstore
from . import params as P
from .registry import register

# fixed values: files written before this instant use the first log schema
EVOLVE_CUTOFF_EPOCH = 1705276800.0   # 2024-01-15 00:00:00 UTC


@register("stored_totals_day")
def stored_totals_day(spark, sf_dir):
    """S4 + S2 + S1: create, append partitioned by dt, read back; the day filter
    prunes ``dt`` partitions."""
    root = scratch_path(spark, "store")
    logstore.create_tables(spark, root)
    logstore.append_log(derive.request_log(spark, sf_dir), root)
    log = logstore.read_log(spark, root)
    return stats.round_averages(stats.totals(log, stats.period_hours("day"), P.AS_OF_EPOCH), P.ROUND_DIGITS)


@register("evolve_schema")
def evolve_schema(spark, sf_dir):
    """Older files lack the six later columns; reading with the full schema
    yields NULL for them."""
    root = scratch_path(spark, "evolve")
    log = derive.request_log(spark, sf_dir)
    old = log.filter(F.col("timestamp") < EVOLVE_CUTOFF_EPOCH)
    new = log.filter(F.col("timestamp") >= EVOLVE_CUTOFF_EPOCH)
    path = f"{root}/{logstore.REQUEST_LOG}"
    old.select(*[f.name for f in LOG_V1.fields], "dt").write.partitionBy("dt").parquet(path)
    new.select(*LOG_COLUMNS, "dt").write.mode("append").partitionBy("dt").parquet(path)
    return derive.log_columns(logstore.read_log(spark, root))


@register("clear_tables")
def clear_tables(spark, sf_dir):
    """Rows per table before and after emptying; schemas are kept."""
    root = scratch_path(spark, "clear")
    logstore.create_tables(spark, root)
    logstore.append_log(derive.request_log(spark, sf_dir), root)
    logstore.append_system_log(derive.system_log(spark, sf_dir), root)
    tables = {"request_log": logstore.read_log, "system_log": logstore.read_system_log}
    folder = scratch_path(spark, "counts")
    for name, read in tables.items():
        (read(spark, root).agg(F.count(F.lit(1)).alias("rows_before"))
         .select(F.lit(name).alias("table_name"), "rows_before").write.mode("append").parquet(folder))
    logstore.clear_tables(spark, root)
    after = [read(spark, root).agg(F.count(F.lit(1)).alias("rows_after")).withColumn("table_name", F.lit(name))
             for name, read in tables.items()]
    return spark.read.parquet(folder).join(after[0].unionByName(after[1]), "table_name") \
        .select("table_name", "rows_before", "rows_after")


@register("system_log_ingest")
def system_log_ingest(spark, sf_dir):
    """S3: application log records arrive as JSON lines and are appended to the
    system log; counted per level and source."""
    root = scratch_path(spark, "syslog")
    src = scratch_path(spark, "syslog-json")
    derive.system_log(spark, sf_dir).write.json(src)
    logstore.create_tables(spark, root)
    logstore.ingest_system_log_json(spark, src, root)
    s = logstore.read_system_log(spark, root)
    return s.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("records"),
        F.count("traceback").alias("with_traceback"))


@register("log_ids")
def log_ids(spark, sf_dir):
    """The log gives the ids. Three appends of rows without id; ids are dense over all of them."""
    root = scratch_path(spark, "ids")
    log = derive.request_log(spark, sf_dir).drop("id").withColumn("_third", F.expr("pmod(xxhash64(struct(*)), 3)"))
    for k in range(3):
        logstore.append_log(log.filter(F.col("_third") == k).drop("_third"), root)
    return logstore.read_log(spark, root).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("id").alias("distinct_ids"), F.min("id").alias("first_id"),
        F.max("id").alias("last_id"), F.sum("total_tokens").alias("total_tokens"))


@register("export_json")
def export_json(spark, sf_dir):
    """The stats document (totals + nested per-model array) as JSON, read
    back with its schema and flattened per model."""
    path = scratch_path(spark, "export-stats")
    doc_df = logstore.stats_document(stats.totals_and_models(derive.request_log(spark, sf_dir)))
    schema = doc_df.schema
    doc_df.coalesce(1).write.json(path)
    back = spark.read.schema(schema).json(path)
    return back.select("total_requests", F.explode("model_requests").alias("m")).select(
        "total_requests", "m.model_id", "m.count", "m.total_tokens", "m.total_compute_burn")


@register("export_models")
def export_models(spark, sf_dir):
    """Totals and models as JSON lines, read back with their schema."""
    path = scratch_path(spark, "export-models")
    rows = stats.round_averages(stats.totals_and_models(derive.request_log(spark, sf_dir)), P.ROUND_DIGITS)
    logstore.export_models_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@register("export_series")
def export_series(spark, sf_dir):
    """The time series of every period as JSON lines, read back."""
    path = scratch_path(spark, "export-series")
    series = {p: stats.time_series(derive.request_log(spark, sf_dir, P.AS_OF_EPOCH - seconds), p, P.AS_OF_EPOCH)
              for p, (_, seconds) in stats.SERIES_PERIODS.items()}
    logstore.export_series_json(series, path)
    return spark.read.schema(series["hour"].schema.add("period", "string")).json(path)


@register("recent_logs_deep")
def recent_logs_deep(spark, sf_dir):
    """L2: a page far back in a stored log; only the dates that hold it are opened."""
    root = scratch_path(spark, "deep")
    logstore.append_log(derive.request_log(spark, sf_dir), root)
    return derive.log_columns(logstore.stored_page(logstore.read_log(spark, root), P.RECENT_LIMIT, P.DEEP_OFFSET))


@register("export_logs_page")
def export_logs_page(spark, sf_dir):
    """A log page exported as JSON lines and read back with the log schema."""
    path = scratch_path(spark, "export-logs")
    page = derive.log_columns(views.recent_logs(derive.request_log(spark, sf_dir), P.RECENT_LIMIT, 0))
    logstore.export_logs_json(page, path)
    return spark.read.schema(LOG).json(path)


__all__ = ["SYSTEM_LOG"]
