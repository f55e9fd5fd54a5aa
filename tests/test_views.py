"""Paging, rendering and the untracked filter."""

from conftest import log_rows

from inference_ledger.operators import views
from test_stats import GOLDEN


def test_recent_logs_pages(spark):
    log = log_rows(spark, GOLDEN)
    p1 = views.recent_logs(log, 2, 0).collect()
    assert p1[0].status_code == 502 and len(p1) == 2
    p2 = views.recent_logs(log, 2, 2).collect()
    assert len(p2) == 1 and p2[0].status_code == 200


def test_negative_limit_and_offset(spark):
    log = log_rows(spark, GOLDEN)
    assert views.recent_logs(log, -1, 0).count() == 3          # T14
    assert views.recent_logs(log, 2, -5).count() == 2


def test_keyset_page(spark):
    log = log_rows(spark, GOLDEN)
    newest = views.recent_logs(log, 1, 0).collect()[0]
    rest = views.logs_before(log, newest.timestamp, newest.id, 10).collect()
    assert [r.id for r in rest] == [2, 1]


def test_log_view_rendering(spark):
    rows = GOLDEN + [dict(model_id="x", status_code=502, duration_ms=1.25, total_tokens=1234567,
                          error_message="e" * 150, ttft_ms=0.0)]
    page = views.log_view(log_rows(spark, rows), 2, 0).collect()
    top = page[0]
    assert top.status_class == "error" and top.tokens_display == "1,234,567"
    assert top.details == "e" * 100 + "..." and top.ttft_display == "--"
    assert top.latency_display == "1.25 ms"
    assert top.has_prev is False and top.has_next is True
    ok = page[1]
    assert ok.details == "OK" and ok.ttft_display == "--" and ok.tokens_display == "9"


def test_stats_view_and_cards(spark):
    v = views.stats_view(log_rows(spark, GOLDEN)).collect()[0]
    assert v.caption == "all time" and v.requests_display == "3" and v.latency_display == "140.00 ms"
    assert v.regular_input_display == "112"
    cards = views.model_cards(log_rows(spark, GOLDEN)).collect()
    assert cards[0].model_id == "heron" and cards[0].speed_display == "31.00 t/s"


def test_untracked_replaces_and_drops(spark):
    log = log_rows(spark, [dict(model_id="cloud-model", status_code=200, duration_ms=1.0),
                           dict(model_id="local-model", status_code=200, duration_ms=1.0)])
    untracked = spark.createDataFrame([("cloud-model",)], "model_id string")
    kept = [r.model_id for r in views.drop_untracked(log, untracked).collect()]
    assert kept == ["local-model"]
    none = spark.createDataFrame([], "model_id string")
    assert views.drop_untracked(log, none).count() == 2


def test_pager_without_limit_has_no_window(spark):
    page = views.with_pager(spark.range(3), -1, 0)
    assert "Window" not in page._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.has_prev, r.has_next) for r in page.collect()} == {(False, False)}
