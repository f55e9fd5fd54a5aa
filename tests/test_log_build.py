"""Request-log build (J8): routing failures, limit rejections and forwarded
requests become log rows; T15/T16/T17/T18 rules."""

import datetime as dt

from inference_ledger.operators import finalize, routing
from inference_ledger.sources import config

CFG = {"backends": [{"id": "b1", "url": "http://one/", "context_size": 10}],
       "model_mappings": [{"model_id": "m", "backend_ids": ["b1"]}],
       "default_model_id": "m", "untracked_models": ["hidden"]}
T0 = dt.datetime(2024, 1, 1)


def _log(spark, include_failed=True, untracked=None):
    reqs = spark.createDataFrame([
        (1, "chat", T0, "m", 5),            # forwarded, 200
        (2, "chat", T0, "alias", 5),        # unmapped -> falls back to the default, logged as "m"
        (3, "chat", T0, "m", 50),           # over the limit -> 400
        (4, "embeddings", T0, "nope", 5),   # no embedding default -> 404
        (5, "chat", T0, "m", 5),            # forwarded, backend 429
    ], "request_id long, protocol string, started_at timestamp_ntz, requested_model string, prompt_tokens long")
    resp = spark.createDataFrame([
        (1, T0 + dt.timedelta(milliseconds=250), 200, None, '{"usage":{"prompt_tokens":4,"completion_tokens":2,"total_tokens":6}}'),
        (2, T0 + dt.timedelta(milliseconds=100), 200, None, '{"choices":[]}'),
        (5, T0 + dt.timedelta(milliseconds=100), 429, "http", "slow down"),
    ], "request_id long, ended_at timestamp_ntz, status_code int, failure_kind string, body string")
    limits = routing.backend_limits(config.backends_df(spark, CFG))
    routed = routing.route(reqs, config.mappings_df(spark, CFG), limits, "m", None)
    return {r.id: r for r in finalize.build_log(routing.check_limit(routed), resp, untracked,
                                                include_failed).collect()}


def test_rows_per_outcome(spark):
    log = _log(spark)
    assert (log[1].status_code, log[1].total_tokens, log[1].duration_ms) == (200, 6, 250.0)
    assert log[1].backend_url == "http://one/v1/chat/completions"
    assert log[2].model_id == "m" and (log[2].prompt_tokens, log[2].completion_tokens) == (5, 0)   # T18, P10
    assert log[3].status_code == 400 and log[3].backend_url == "http://one/"                       # T17
    assert (log[3].prompt_tokens, log[3].completion_tokens, log[3].total_tokens) == (50, 0, 50)
    assert log[4].status_code == 404 and log[4].backend_url == "N/A" and log[4].model_id == "nope"
    assert log[4].total_tokens is None and "not mapped" in log[4].error_message
    assert log[5].status_code == 429 and log[5].error_message == "Backend HTTP 429: slow down"


def test_include_failed_false(spark):
    assert sorted(_log(spark, include_failed=False)) == [1, 2]                                      # T16


def test_untracked_applies_to_logged_id(spark):
    hidden = spark.createDataFrame([("m",)], "model_id string")
    assert sorted(_log(spark, untracked=hidden)) == [4]                                               # T15
