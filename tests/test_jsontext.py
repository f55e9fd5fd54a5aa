"""JSON rewritten as text, against Python's own json."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inference_ledger.functions import jsontext, prompts

TEXTS = ['{"a":1,"b":{"c":[1,2,{"d":null}],"e":"x, y: {z}"},"f":[]}', '{"k":"q\\"uo\\\\te","l":"caf\\u00e9 大坝 😀 \\n\\t\\u0001\\u007f/"}',
         '{"n":[0.5,1.50,1e3,2.5E-3,-0.0,12345678901234567890,true,false,null,1.0]}', '{}', '{"a":{}}',
         '{"a":1,"a":2}', '{"a":{"b":1,"b":{"c":1,"c":2}},"z":0,"a":{"b":3,"x":[{"y":1,"y":[2]}]}}', '{"a":"1","\\u0061":"2"}']


def one(spark, expr, texts):
    return [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(expr.alias("x")).collect()]


def test_python_spelling(spark):
    got = one(spark, jsontext.python_json(F.get_json_object("t", "$")), TEXTS[:5])
    assert got == [json.dumps(json.loads(t)) for t in TEXTS[:5]]


def test_last_wins_at_every_depth(spark):
    df = jsontext.last_wins(spark.createDataFrame([(t,) for t in TEXTS + ["not-json{", "[1,2", "", None, "[1,1]"]], "t string"),
                            "t", "v", "x")
    for r in df.select("t", "x", F.to_json("v").alias("v")).collect():
        try:
            want = json.loads(r.t)
        except (ValueError, TypeError):
            assert r.v is None, r.t
            continue
        assert json.loads(r.v) == want and json.loads(r.x) == want, r.t


JSON = st.recursive(st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(st.characters(codec="utf-8"), max_size=6),
                    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(JSON, min_size=30, max_size=60))
def test_any_document_is_spelled_as_python_spells_it(spark, docs):
    texts = [json.dumps({"x": d}, ensure_ascii=k % 2 == 0) for k, d in enumerate(docs)]
    assert one(spark, jsontext.python_json(F.get_json_object("t", "$")), texts) == [json.dumps(json.loads(t)) for t in texts]
    m = F.expr(jsontext.members(jsontext.canonical("t")))
    got = one(spark, m, texts)
    assert [json.loads("{" + ",".join(f"{k}:{v}" for k, v in zip(g["keys"], g["vals"])) + "}") for g in got] == [json.loads(t) for t in texts]


def test_payload_drops_nulls_of_records_only(spark):
    rows = [("chat", True, '{"model":"m","top_p":null,"messages":[{"name":null,"content":"c","role":"user"},{"role":"x","content":null,"t":[null,{"n":null}]}],'
                           '"tools":[{"f":{"strict":null}}],"stream_options":{"include_usage":false,"every":3}}'),
            ("responses", True, '{"model":"m","input":[{"role":"u","name":null}],"stream":true}'),
            ("messages", False, '{"model":"a","model":"b","messages":[{"role":"u","name":null}],"metadata":null}'),
            ("chat", True, '{"model":"m","stream_options":"as is"}'), ("chat", False, '{"model":"m","stream_options":null}'),
            ("chat", True, "nope")]
    df = spark.createDataFrame(rows, "protocol string, force boolean, body string")
    got = [r.p for r in prompts.with_payload(df, "body", "protocol = 'chat'", "force", "p").collect()]
    assert got == [
        '{"model":"m","messages":[{"role":"user","content":"c"},{"role":"x","t":[null,{"n":null}]}],"tools":[{"f":{"strict":null}}],'
        '"stream_options":{"include_usage":true,"every":3}}',
        '{"model":"m","input":[{"role":"u","name":null}],"stream":true,"stream_options":{"include_usage":true}}',
        '{"model":"b","messages":[{"role":"u","name":null}]}', '{"model":"m","stream_options":"as is"}', '{"model":"m"}', None]
