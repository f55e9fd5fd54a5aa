"""Registered streaming queries: T-S1 .. T-S6. Each puts one half of the derived capture
table (by a hash of the row, so in no order of time) as Parquet files in the shared
folder, runs the job over them a few files at a time, adds the other half, and starts the
job again on the same sink: several batches, out of order, and a restart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing, sse, stats
from ..functions.prompts import with_estimate
from ..session import scratch_path
from ..sources import config, derive
from ..sources.tables import read_table
from ..streaming import jobs
from . import params as P
from .q_routing import CFG, prepare_requests
from .q_sse import PART_LINES, SSE_OUT
from .registry import register


FILES = 4            # per half, at least


def files_of(spark):
    """Files per half. A batch takes half of them, one or more for every core: the readers' tasks follow the
    files, since what is captured packs well and a large file has few row groups to split."""
    return max(FILES, 2 * spark.sparkContext.defaultParallelism)


def per_batch(spark):
    return files_of(spark) // 2


def _twice(df, source, job, fmt="parquet"):
    """Both halves of ``df`` to ``source``, the job after each; its last result."""
    files = files_of(df.sparkSession)
    halves = df.withColumn("_half", F.expr("pmod(xxhash64(struct(*)), 2)"))
    for half in (1, 0):
        (halves.filter(F.col("_half") == half).drop("_half").repartition(files)
         .write.mode("append").format(fmt).save(source))
        out = job()
    return out


def _log(spark, sf_dir):
    return derive.request_log(spark, sf_dir)


@register("stream_append")
def stream_append(spark, sf_dir):
    src, sink = scratch_path(spark, "src-log"), scratch_path(spark, "sink-log")
    out = _twice(_log(spark, sf_dir), src, lambda: jobs.append_log_stream(spark, src, sink, per_batch(spark)))
    return derive.log_columns(out)


@register("stream_totals")
def stream_totals(spark, sf_dir):
    src, sink = scratch_path(spark, "src-log"), scratch_path(spark, "sink-totals")
    t = _twice(_log(spark, sf_dir), src, lambda: jobs.live_totals(spark, src, sink, per_batch(spark)))
    return stats.round_averages(t, P.ROUND_DIGITS)


@register("stream_recent")
def stream_recent(spark, sf_dir):
    src, sink = scratch_path(spark, "src-log"), scratch_path(spark, "sink-recent")
    return _twice(_log(spark, sf_dir), src, lambda: jobs.live_recent(spark, src, sink, P.RECENT_LIMIT, per_batch(spark)))


def _series(spark, sf_dir, period):
    src, sink = scratch_path(spark, "src-log"), scratch_path(spark, f"sink-series-{period}")
    return _twice(_log(spark, sf_dir), src, lambda: jobs.live_series(spark, src, sink, period, per_batch(spark)))


@register("stream_series")
def stream_series(spark, sf_dir):
    return _series(spark, sf_dir, "hour")


@register("stream_series_day")
def stream_series_day(spark, sf_dir):
    return _series(spark, sf_dir, "day")


@register("stream_series_month")
def stream_series_month(spark, sf_dir):
    return _series(spark, sf_dir, "month")


TURNS_PER_FILE = 4096


def wave_files(spark, turns):
    """Files of a wave, which is one batch: one for every core, where there are turns enough that none is empty."""
    return min(spark.sparkContext.defaultParallelism, 1 + turns // TURNS_PER_FILE)


def _final(spark, sf_dir, folded, texts):
    req = with_estimate(derive.stream_requests(spark, sf_dir))
    return sse.with_text(sse.finalize_streams(folded, req), texts).select(*SSE_OUT)


@register("stream_sse")
def stream_sse(spark, sf_dir):
    src, sink = scratch_path(spark, "src-sse"), scratch_path(spark, "sink-sse")
    lines = derive.sse_lines(spark, sf_dir)
    parts = _twice(lines, src, lambda: jobs.live_sse_fold(spark, src, sink, lines.schema, per_batch(spark), part_lines=PART_LINES))
    folder = scratch_path(spark, "merged-sse")        # merged once, read for the counts and for the texts
    parts.write.parquet(folder)
    parts = spark.read.parquet(folder)
    return _final(spark, sf_dir, sse.stitch(parts), sse.text_parts(parts))


@register("stream_finished")
def stream_finished(spark, sf_dir):
    """T-S1 emission: the last lines of all streams come first, then the rest in two batches, the job starting
    again before the last; the newest revisions equal the fold of all lines."""
    src, sink = scratch_path(spark, "src-ends"), scratch_path(spark, "sink-finished")
    lines = derive.sse_lines(spark, sf_dir)
    wave = lines.withColumn("_wave", F.expr(f"IF(seq >= {derive.SEQ_DONE}, 0, 1 + pmod(xxhash64(request_id, seq), 2))"))
    files = wave_files(spark, read_table(spark, sf_dir, "conversations").count())
    for waves in ((0, 1), (2,)):
        for k in waves:
            wave.filter(F.col("_wave") == k).drop("_wave").repartition(files).write.mode("append").parquet(src)
        done, texts = jobs.live_finished(spark, src, sink, lines.schema, max_files=files, part_lines=PART_LINES)
    return _final(spark, sf_dir, done, texts)


@register("stream_route")
def stream_route(spark, sf_dir):
    src, sink = scratch_path(spark, "src-req"), scratch_path(spark, "sink-route")
    reqs = derive.requests(spark, sf_dir)
    limits = routing.backend_limits(config.backends_df(spark, CFG))
    return _twice(reqs, src, lambda: jobs.live_route(
        spark, src, sink, reqs.schema, config.mappings_df(spark, CFG), limits, CFG.get("default_model_id"),
        CFG.get("default_embedding_model_id"), prepare_requests, per_batch(spark)))


@register("stream_system_recent")
def stream_system_recent(spark, sf_dir):
    """T-S4 for the system log: live newest-first top-k of arriving records."""
    from ..schemas import SYSTEM_LOG
    src, sink = scratch_path(spark, "src-syslog"), scratch_path(spark, "sink-sysrecent")
    cols = [f.name for f in SYSTEM_LOG.fields]
    return _twice(derive.system_log(spark, sf_dir), src, lambda: jobs.live_recent(
        spark, src, sink, P.SYSTEM_LOG_LIMIT, per_batch(spark), schema=SYSTEM_LOG, columns=cols, source_format="json"), "json")


@register("stream_system_ingest")
def stream_system_ingest(spark, sf_dir):
    """S3 as a stream: records without ids get dense ones, lines that are no record are kept apart."""
    src, sink = scratch_path(spark, "src-syslog"), scratch_path(spark, "sink-syslog")
    stored, bad = _twice(derive.system_log_lines(spark, sf_dir), src,
                         lambda: jobs.ingest_system_log_stream(spark, src, sink, per_batch(spark)), "text")
    count = F.count(F.lit(1)).alias("records")
    none = F.lit(None).cast("long")
    by_name = stored.groupBy("level", "name").agg(count, F.count("traceback").alias("with_traceback")).select(
        F.lit("stored").alias("kind"), "*", none.alias("id_span"))
    ids = stored.agg(F.count_distinct("id").alias("records"), F.count("traceback").alias("with_traceback"),
                     F.max("id").alias("id_span")).select(F.lit("ids").alias("kind"), F.lit(None).cast("string").alias("level"),
                                                          F.lit(None).cast("string").alias("name"), "*")
    apart = bad.agg(count).select(F.lit("quarantined").alias("kind"), F.lit(None).cast("string").alias("level"),
                                  F.lit(None).cast("string").alias("name"), "records", none.alias("with_traceback"), none.alias("id_span"))
    return by_name.unionByName(ids).unionByName(apart)
