"""Usage normalisation and non-stream finalisation on own bodies."""

import json

import pytest
from pyspark.sql import functions as F

from inference_ledger.operators import finalize


def final(spark, body, protocol="chat", estimate=21, status=200, kind=None):
    text = body if body is None or isinstance(body, str) else json.dumps(body)
    df = spark.createDataFrame([(1, protocol, estimate, status, kind, text)], "request_id long, protocol string, "
                               "est long, status_code int, failure_kind string, body string")
    return finalize.finalize_responses(df, "est").collect()[0]


def counts(r):
    return r.prompt_tokens, r.completion_tokens, r.total_tokens


@pytest.mark.parametrize("protocol,body,want", [
    ("chat", {"usage": {"prompt_tokens": 314, "completion_tokens": 27, "total_tokens": 341}}, (314, 27, 341)),
    ("chat", {"usage": {"prompt_tokens": 314, "completion_tokens": 27}}, (314, 27, 341)),
    ("responses", {"usage": {"input_tokens": 808, "output_tokens": 64, "total_tokens": 900}}, (808, 64, 900)),
    ("responses", {"usage": {"input_tokens": 808, "output_tokens": 64}}, (808, 64, 872)),
    ("embeddings", {"usage": {"prompt_tokens": 19, "total_tokens": 19}}, (19, 0, 19)),
    ("embed_native", {"prompt_eval_count": 44}, (44, 0, 44)),
    ("chat", {"usage": {}}, (21, 0, 21)),
    ("responses", {"output": []}, (21, 0, 21)),
])
def test_dialects(spark, protocol, body, want):
    r = final(spark, body, protocol)
    assert counts(r) == want and r.final_status == 200 and r.error_message is None


def test_timings_and_cache(spark):
    r = final(spark, {"usage": {"prompt_tokens": 90, "completion_tokens": 6, "prompt_tokens_details": {"cached_tokens": 41}},
                      "timings": {"prompt_ms": 812.25, "predicted_per_second": 7.75}})
    assert (r.ttft_ms, r.tokens_per_second, r.prompt_cached_tokens) == (812.25, 7.75, 41)


@pytest.mark.parametrize("usage", [
    {"prompt_tokens": None, "input_tokens": 33, "completion_tokens": 4},
    {"prompt_tokens": 5.5, "completion_tokens": 4},
    {"prompt_tokens": "many", "completion_tokens": 4},
    {"prompt_tokens": 8, "completion_tokens": 4, "prompt_tokens_details": {"cached_tokens": 2, "audio_tokens": None}},
    {"prompt_tokens": 8, "completion_tokens": 4, "cache_read_input_tokens": "all"},
])
def test_invalid_usage_is_an_internal_error(spark, usage):
    r = final(spark, {"usage": usage}, estimate=58)
    assert r.final_status == 500 and counts(r) == (58, 0, 58)


@pytest.mark.parametrize("body", ["[4,5]", "null", '"text"', "17", "<p>gone</p>", "", None])
def test_a_success_must_be_an_object(spark, body):
    r = final(spark, body, estimate=58)
    assert r.final_status == 500 and r.error_message and counts(r) == (58, 0, 58)


def test_failures(spark):
    r = final(spark, {"error": {"message": "slow down, please", "type": "busy"}}, status=503, kind="http")
    assert r.final_status == 503 and r.error_message.startswith("Backend HTTP 503: ")
    r = final(spark, None, status=0, kind="connection")
    assert r.final_status == 502 and r.error_message.startswith("Connection error")


def test_error_payload_passes_or_is_wrapped(spark):
    own = '{"error":{"message":"no such lamp","type":"lookup"}}'
    df = spark.createDataFrame([(own, 404), ("out of oil", 507), ("[1]", 500)], "body string, status int")
    payload, detail = finalize.backend_error_payload(F.col("body"), F.col("status"), F.lit(True))
    rows = df.select(payload.alias("p"), detail.alias("d")).collect()
    assert (rows[0].p, rows[0].d) == (own, "no such lamp")
    assert json.loads(rows[1].p) == {"error": {"message": "out of oil", "type": "api_error", "code": 507}}
    assert rows[1].d == "out of oil" and json.loads(rows[2].p)["error"]["message"] == "[1]"
