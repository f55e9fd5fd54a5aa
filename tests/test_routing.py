"""Routing, limits and catalog (golden cases)."""

from pyspark.sql import functions as F

from inference_ledger.operators import routing
from inference_ledger.sources import config

CFG = {
    "backends": [{"id": "b1", "url": "http://one/", "context_size": 1},
                 {"id": "b2", "url": "http://two"}],
    "model_mappings": [{"model_id": "single", "backend_ids": ["b1"]},
                       {"model_id": "multi", "backend_ids": ["b1", "b2"]},
                       {"model_id": "broken", "backend_ids": ["nope"]}],
    "default_model_id": None,
}


def _route(spark, cfg, reqs, pick="hash", default=None, emb=None):
    df = spark.createDataFrame(reqs, "request_id long, protocol string, requested_model string, prompt_tokens long")
    limits = routing.backend_limits(config.backends_df(spark, cfg))
    r = routing.route(df, config.mappings_df(spark, cfg), limits, default, emb, pick)
    return routing.check_limit(r)


def test_single_multi_missing_broken(spark):
    reqs = [(i, "chat", "multi", 0) for i in range(100)] + [
        (1000, "chat", "single", 0), (1001, "chat", "unknown", 0), (1002, "chat", "broken", 0)]
    rows = {r.request_id: r for r in _route(spark, CFG, reqs).collect()}
    assert rows[1000].target_url == "http://one/v1/chat/completions"
    assert {rows[i].backend_id for i in range(100)} == {"b1", "b2"}
    assert rows[1001].route_status == 404 and rows[1001].logged_model == "unknown"
    assert rows[1002].route_status == 503


def test_default_fallback_logs_default(spark):
    rows = _route(spark, CFG, [(1, "chat", "alias", 0), (2, "embeddings", "alias", 0)],
                  default="single", emb="multi").collect()
    by = {r.request_id: r for r in rows}
    assert by[1].resolved_model == "single" and by[1].logged_model == "single"
    assert by[2].resolved_model == "multi"


def test_limit_strict(spark):
    rows = {r.request_id: r for r in _route(spark, CFG, [(1, "chat", "single", 5), (2, "chat", "single", 1),
                                                        (3, "messages", "single", 5)]).collect()}
    assert rows[1].limit_status == 400 and "exceeds the available context size" in rows[1].limit_message
    assert '"code":400' in rows[1].limit_error
    assert rows[2].limit_status == 200                                   # equal is allowed
    assert '"invalid_request_error"' in rows[3].limit_error and '"code"' not in rows[3].limit_error


def test_limits_override_beats_probe(spark):
    cfg = {"backends": [{"id": "a", "url": "http://a/v1/", "context_size": 2048},
                        {"id": "b", "url": "http://b"}, {"id": "c", "url": "http://c"}],
           "model_mappings": []}
    props = spark.createDataFrame([("http://a/props", '{"default_generation_settings":{"n_ctx":4096}}'),
                                   ("http://b/props", '{"default_generation_settings":{"n_ctx":8192}}'),
                                   ("http://c/props", '{"other":1}')], "props_url string, json string")
    lim = {r.id: r.context_limit for r in routing.backend_limits(config.backends_df(spark, cfg), props).collect()}
    assert lim == {"a": 2048, "b": 8192, "c": None}


def test_catalog(spark):
    cfg = {"backends": [{"id": "b1", "url": "http://1", "context_size": 8192},
                        {"id": "b2", "url": "http://2", "context_size": 16384}],
           "model_mappings": [{"model_id": "chat-model", "backend_ids": ["b1", "b2"]},
                              {"model_id": "embed-model", "backend_ids": ["b2"]},
                              {"model_id": "orphan-model", "backend_ids": ["ghost"]}]}
    m, b = config.mappings_df(spark, cfg), config.backends_df(spark, cfg)
    limits = routing.backend_limits(b)
    br = {r.id: r for r in routing.model_browser(m, b, limits, "chat-model", "embed-model").collect()}
    assert br["chat-model"].context_length == 16384 and br["chat-model"].is_default
    assert br["embed-model"].is_default_embedding and not br["embed-model"].is_default
    orphan = br["orphan-model"]
    assert orphan.context_length is None and orphan.backends[0].configured is False
    assert orphan.backends[0].url is None
    lst = {r.id: r.context_length for r in routing.model_list(m, limits).collect()}
    assert lst["orphan-model"] == 4096 and lst["chat-model"] == 16384


def test_target_and_props_urls(spark):
    df = spark.createDataFrame([("http://h:1/",), ("http://h:1/v1",), ("http://h:1/v1///",)], "u string")
    rows = df.select(routing.target_url(F.col("u"), F.lit("chat")).alias("t"),
                     routing.props_url(F.col("u")).alias("p")).collect()
    assert rows[0].t == "http://h:1/v1/chat/completions"
    assert [r.p for r in rows] == ["http://h:1/props"] * 3
