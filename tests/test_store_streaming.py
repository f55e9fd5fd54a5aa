"""Storage round trips (S2-S6) and streaming == batch (T-S2, T-S3, T-S5)."""

import datetime as dt
import tempfile

from conftest import log_rows
from pyspark.sql import functions as F

from inference_ledger.functions.timefmt import bucket_label
from inference_ledger.operators import stats
from inference_ledger.schemas import LOG_V1
from inference_ledger.sources import logstore
from inference_ledger.streaming import jobs
from test_stats import GOLDEN

T0 = dt.datetime(2031, 5, 4)


def test_create_append_evolve_clear(spark):
    root = tempfile.mkdtemp(prefix="ledger-store-")
    logstore.create_tables(spark, root)
    assert logstore.read_log(spark, root).count() == 0
    log = log_rows(spark, GOLDEN)
    # an "old" file without the later columns, then a current one
    log.select(*[f.name for f in LOG_V1.fields], "dt").write.mode("append").partitionBy("dt") \
        .parquet(f"{root}/{logstore.REQUEST_LOG}")
    logstore.append_log(log, root)
    back = logstore.read_log(spark, root)
    assert back.count() == 6
    assert back.filter(F.col("ttft_ms").isNotNull()).count() == 2           # old rows read NULL
    logstore.clear_tables(spark, root)
    assert logstore.read_log(spark, root).count() == 0
    assert logstore.read_system_log(spark, root).count() == 0


def test_usage_struct_flattened(spark):
    df = spark.createDataFrame(
        [(1, {"prompt_tokens": 3, "completion_tokens": 1, "total_tokens": 4,
              "prompt_tokens_details": {"cached_tokens": 2}, "completion_tokens_details": None,
              "cache_creation_input_tokens": None, "cache_read_input_tokens": 5})],
        "id long, usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,"
        "prompt_tokens_details:map<string,bigint>,completion_tokens_details:map<string,bigint>,"
        "cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>")
    r = logstore.flatten_usage(df).collect()[0]
    assert (r.prompt_tokens, r.prompt_cached_tokens, r.cache_read_input_tokens) == (3, 2, 5)


def test_streams_over_batches_and_restarts(spark):
    """Every job sees several files in no order of time, one per batch, ends, and starts again on its sink."""
    root = tempfile.mkdtemp(prefix="ledger-streams-")
    rows = [{**r, "timestamp": 1_700_000_000.0 + 3600 * ((k * 37) % 90)} for k, r in enumerate(GOLDEN * 12)]
    log = log_rows(spark, rows)
    src = f"{root}/log"
    for start in (0, 1):
        log.filter(F.col("id") % 2 == start).repartition(3).write.mode("append").partitionBy("dt").parquet(src)
        live = jobs.live_totals(spark, src, f"{root}/totals", max_files=1)
        appended = jobs.append_log_stream(spark, src, f"{root}/append", max_files=1)
        recent = jobs.live_recent(spark, src, f"{root}/recent", 5, max_files=1)
        series = {p: jobs.live_series(spark, src, f"{root}/series-{p}", p, max_files=1) for p in ("hour", "day", "month")}
    assert stats.round_averages(live, 6).collect() == stats.round_averages(stats.totals(log), 6).collect()
    assert sorted(r.id for r in appended.collect()) == sorted(r.id for r in log.collect())
    newest = log.orderBy(F.desc("timestamp"), F.desc("id")).limit(5).collect()
    assert [r.id for r in recent.orderBy(F.desc("timestamp"), F.desc("id")).collect()] == [r.id for r in newest]
    for period, got in series.items():
        want = log.groupBy(bucket_label(F.col("timestamp"), period).alias("label")).agg(F.count("*").alias("n")).collect()
        assert sorted((r.label, r.requests) for r in got.collect()) == sorted((r.label, r.n) for r in want)
    # a start without new files changes nothing
    again = jobs.live_totals(spark, src, f"{root}/totals", max_files=1)
    assert again.collect() == live.collect()
