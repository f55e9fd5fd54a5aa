"""Aggregates on own hand-made rows."""

from conftest import log_rows

from inference_ledger.operators import stats

GOLDEN = [
    dict(model_id="heron", backend_url="http://pond:81", status_code=200, duration_ms=310.0,
         prompt_tokens=70, completion_tokens=12, total_tokens=82, ttft_ms=44.0, tokens_per_second=31.0),
    dict(model_id="stork", backend_url="http://roof:82", status_code=200, duration_ms=90.0,
         prompt_tokens=33, completion_tokens=4, total_tokens=37, ttft_ms=20.0, tokens_per_second=55.0),
    dict(model_id="heron", backend_url="http://pond:81", status_code=502, duration_ms=20.0,
         prompt_tokens=9, completion_tokens=0, total_tokens=9),
]


def test_totals_golden(spark):
    t = stats.totals(log_rows(spark, GOLDEN)).collect()[0]
    assert t.total_requests == 3
    assert (t.total_input_tokens, t.total_output_tokens, t.total_tokens) == (112, 16, 128)
    assert t.avg_duration_ms == 140.0          # failed requests dilute averages (T21)
    assert t.avg_tokens_per_second == 43.0


def test_model_rollup_counts_and_order(spark):
    rows = stats.model_rollup(log_rows(spark, GOLDEN)).collect()
    assert [(r.model_id, r["count"]) for r in rows] == [("heron", 2), ("stork", 1)]


def test_empty_store_zero_fill(spark):
    t = stats.totals(log_rows(spark, GOLDEN).limit(0)).collect()[0]
    assert t.total_requests == 0 and t.total_tokens == 0 and t.avg_ttft_ms == 0.0
    assert stats.model_rollup(log_rows(spark, GOLDEN).limit(0)).count() == 0


def test_all_null_usage_keeps_null(spark):
    # Rows exist but usage is NULL -> sums stay NULL (no zero fill)
    t = stats.totals(log_rows(spark, [dict(model_id="m", status_code=404, duration_ms=1.0)])).collect()[0]
    assert t.total_requests == 1 and t.total_tokens is None


def test_compute_burn(spark):
    rows = [dict(model_id="m", status_code=200, duration_ms=1.0, prompt_tokens=640, completion_tokens=35,
                 total_tokens=675, cache_read_input_tokens=201, cache_creation_input_tokens=18)]
    t = stats.totals(log_rows(spark, rows)).collect()[0]
    assert t.total_cached_tokens == 201 and t.total_compute_burn == 474


def test_hours_zero_means_all(spark):
    log = log_rows(spark, GOLDEN)
    assert stats.totals(log, 0, 2_000_000_000.0).collect()[0].total_requests == 3      # T1
    assert stats.totals(log, 1, 2_000_000_000.0).collect()[0].total_requests == 0


def test_time_filter_inclusive_and_partition_predicate(spark):
    log = log_rows(spark, GOLDEN)
    as_of = 1_700_000_001.0 + 3600
    assert stats.totals(log, 1, as_of).collect()[0].total_requests == 2                 # >= bound
    plan = stats.filter_since(log, 1_700_000_000.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "dt" in plan


def test_series_labels_and_unknown_period(spark):
    log = log_rows(spark, GOLDEN)
    s = stats.time_series(log, "hour", 1_700_000_100.0).collect()
    assert [(r.label, r.requests, r.tokens) for r in s] == [("2023-11-14 22:00", 3, 128)]
    assert stats.time_series(log, "month", 1_700_000_100.0).collect()[0].label == "2023-11"
    assert stats.time_series(log, "week", 1_700_000_100.0).count() == 0


def test_totals_and_models_single_scan(spark):
    rows = stats.totals_and_models(log_rows(spark, GOLDEN)).collect()
    by = {(r.level, r.model_id): r.requests for r in rows}
    assert by == {("total", None): 3, ("model", "heron"): 2, ("model", "stork"): 1}
