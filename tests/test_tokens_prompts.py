"""Token estimates (P14), content flattening (P13), prompt texts, validation,
payload normalisation (P26, P27) and configuration loading (S7)."""

import json

import pytest
from pyspark.sql import functions as F

from inference_ledger.functions import prompts, tokens
from inference_ledger.sources import config


def _one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).collect()[0].y


def test_estimate_golden(spark):
    assert _one(spark, tokens.estimate_tokens, "Seven kettles, all green; none empty?") == 9
    assert _one(spark, tokens.estimate_tokens, "") == 0
    assert _one(spark, tokens.estimate_tokens, "a <|endoftext|> b") == 3       # special token = one piece


def test_flatten_content(spark):
    lst = json.dumps([{"type": "text", "text": "grey mare;"}, {"type": "text", "text": " old cart"},
                      {"type": "image_url", "image_url": {"url": "x"}}, {"type": "other"}])
    flat = _one(spark, tokens.flatten_content, lst)
    assert flat == "grey mare; old cart"
    assert _one(spark, lambda c: tokens.estimate_tokens(tokens.flatten_content(c)), lst) == 5
    assert _one(spark, tokens.flatten_content, json.dumps([{"type": "image_url"}])) == ""
    assert _one(spark, tokens.flatten_content, json.dumps("plain")) == "plain"


def test_prompt_text_per_protocol(spark):
    rows = [("chat", '{"model":"m","messages":[{"role":"user","content":"hi"}],"tools":[{"t":1}]}'),
            ("responses", '{"model":"m","instructions":"Be.","input":"hi"}'),
            ("messages", '{"model":"m","system":"S","messages":[{"role":"user","content":"hi"}]}'),
            ("embeddings", '{"model":"m","input":["a","b"]}'),
            ("embed_native", '{"model":"m","input":"a"}')]
    df = spark.createDataFrame(rows, "protocol string, body string")
    out = [r.t for r in df.select(prompts.prompt_text(F.col("protocol"), F.col("body")).alias("t")).collect()]
    assert out[0] == '[{"role": "user", "content": "hi"}][{"t": 1}]'
    assert out[1] == 'Be."hi"'
    assert out[2] == '[{"role": "user", "content": "hi"}]S'
    assert out[3] == "a\nb"
    assert out[4] == ""


def test_validation(spark):
    rows = [("chat", "not-json{"), ("chat", '{"messages":[]}'), ("chat", '{"model":"m"}'),
            ("embed_native", '{"model":""}'), ("embeddings", '{"model":"m","input":null}'),
            ("chat", '{"model":"","messages":[]}')]
    df = spark.createDataFrame(rows, "protocol string, body string")
    r = [x.r for x in df.select(prompts.reject_reason(F.col("protocol"), F.col("body")).alias("r")).collect()]
    bad = [("chat", '{"model":"m","messages":[1]}'), ("chat", '{"model":"m","messages":[{"content":"x"}]}'),
           ("chat", '{"model":"m","messages":[{"role":"user","content":7}]}'),
           ("messages", '{"model":"m","messages":["x"]}'), ("responses", '{"model":"m","input":5}'),
           ("embeddings", '{"model":"m","input":{}}'), ("chat", '{"model":"m","messages":[],"stream":"maybe"}'),
           ("chat", '{"model":"m","messages":[{"role":"user"},{"role":"user","content":[{"a":1}]}],"stream":"yes"}'),
           ("responses", '{"model":"m","input":[{"a":1}],"stream":null}'), ("messages", '{"model":"m","messages":[{}]}')]
    got = [x.r for x in spark.createDataFrame(bad, "protocol string, body string").select(
        prompts.reject_reason(F.col("protocol"), F.col("body")).alias("r")).collect()]
    assert got == ["invalid_messages"] * 4 + ["invalid_input"] * 2 + ["invalid_stream"] + [None] * 3
    assert r == ["invalid_json", "missing_model", "missing_messages", "missing_model", "missing_input", None]


def test_config_loading(tmp_path):
    good = {"backends": [{"id": "b", "url": "http://b"}], "model_mappings": [{"model_id": "m", "backend_ids": ["b"]}]}
    assert config.load_config(good)["backends"][0]["id"] == "b"
    with pytest.raises(config.ConfigError):
        config.load_config({"backends": []})
    with pytest.raises(config.ConfigError):
        config.load_config({"backends": [{"id": "b"}], "model_mappings": []})
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "missing.json"))
    p = tmp_path / "c.json"
    p.write_text(json.dumps(good))
    assert config.load_config(str(p))["model_mappings"][0]["model_id"] == "m"


def test_backends_drop_credentials(spark):
    b = config.backends_df(spark, config.DEMO_CONFIG)
    assert "api_key" not in b.columns and b.count() == 4
