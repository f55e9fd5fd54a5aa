"""Capture tables derived from the given tables.

The analytics run on a request log, a system log, captured request bodies,
captured response bodies and captured SSE lines. The test data ships none of
those, so they are derived deterministically -- row for row, no sampling --
from ``events`` and ``conversations``; routing dimensions for the catalog come
from ``supplier``, ``part`` and ``lineitem``. Every derivation is a narrow
projection (no shuffle) except where noted. The same rules are restated in SQL
in ``plans/oracle.py``.
"""

from __future__ import annotations

import math
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqltext
from ..functions.timefmt import _EPOCH_NTZ, epoch_date, epoch_seconds
from ..schemas import LOG_COLUMNS
from ..session import spread
from .tables import read_table

# fixed values: model ids by user_id % 6, protocol path and event-type mapping
MODEL_BY_USER_MOD6 = ["chat-large", "chat-medium", "chat-small", "embed-text",
                      "unmapped-model", "orphan-model"]
PROTOCOL_BY_EVENT = {"click": "chat", "error": "chat", "view": "responses",
                     "signup": "messages", "purchase": "embeddings"}
PATH_BY_PROTOCOL = {"chat": "/v1/chat/completions", "responses": "/v1/responses",
                    "messages": "/v1/messages", "embeddings": "/v1/embeddings",
                    "embed_native": "/api/embed", "embeddings_native": "/api/embeddings"}
ERROR_TEXT_500 = ("Internal error (RuntimeError): upstream closed the stream before the final "
                  "chunk was received; partial output discarded (props ")
ERROR_TEXT_502 = "Connection error (ConnectError): all connection attempts failed"
ERROR_TEXT_429 = 'Backend HTTP 429: {"error":{"message":"tray 1 is empty","type":"paper"}}'


def _case(key: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(key == F.lit(k), F.lit(v)) if out is None
               else out.when(key == F.lit(k), F.lit(v)))
    return out.otherwise(F.lit(default)) if default is not None else out


def model_for_user(user_id: Column) -> Column:
    return _case(F.pmod(user_id, F.lit(6)), dict(enumerate(MODEL_BY_USER_MOD6)))


_sql_case = sqltext.case
_sql_lit = sqltext.literal


def request_log_from_events(events: DataFrame) -> DataFrame:
    """Request log (15 columns + ``dt``), one row per event.

    Written as two SQL select lists: building the same projection from
    hundreds of Column objects costs one driver round trip per operator."""
    model = _sql_case("pmod(user_id, 6)", dict(enumerate(MODEL_BY_USER_MOD6)))
    path = _sql_case("event_type", {e: PATH_BY_PROTOCOL[p] for e, p in PROTOCOL_BY_EVENT.items()})
    base = events.selectExpr(
        "event_id", "user_id", "event_type", "props",
        "event_id % 41 <> 0 AS _has_usage",
        "CAST(get_json_object(props, '$.k') AS BIGINT) * 10 + event_id % 7 AS _pt",
        "CASE WHEN event_type IN ('error', 'purchase') THEN CAST(0 AS BIGINT) ELSE event_id % 97 END AS _ct",
        "CAST(CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 500 WHEN 1 THEN 502 "
        "ELSE 429 END ELSE 200 END AS INT) AS _status",
        "value * 10.0D AS _duration",
        "CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value * 2.5D END AS _ttft",
        f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, CAST(ts AS TIMESTAMP_NTZ)) / 1000000.0D AS _epoch",
    )
    return base.selectExpr(
        "event_id AS id",
        "_epoch AS timestamp",
        f"{model} AS model_id",
        f"concat('http://h', CAST(pmod(user_id, 4) + 1 AS STRING), ':8080', {path}) AS backend_url",
        "_status AS status_code",
        "_duration AS duration_ms",
        "CASE WHEN _has_usage THEN _pt END AS prompt_tokens",
        "CASE WHEN _has_usage THEN _ct END AS completion_tokens",
        "CASE WHEN _has_usage THEN _pt + _ct END AS total_tokens",
        "CAST(CASE WHEN _has_usage AND event_id % 3 = 0 THEN floor(_pt / 2) END AS BIGINT) AS prompt_cached_tokens",
        "CAST(CASE WHEN _has_usage AND event_id % 11 = 0 THEN floor(_pt / 8) END AS BIGINT) AS cache_creation_input_tokens",
        "CAST(CASE WHEN _has_usage AND event_id % 5 = 0 THEN floor(_pt / 4) END AS BIGINT) AS cache_read_input_tokens",
        f"CASE _status WHEN 500 THEN concat({_sql_lit(ERROR_TEXT_500)}, props, ')') "
        f"WHEN 502 THEN {_sql_lit(ERROR_TEXT_502)} WHEN 429 THEN {_sql_lit(ERROR_TEXT_429)} END AS error_message",
        "_ttft AS ttft_ms",
        "CASE WHEN _ttft IS NOT NULL AND _duration > _ttft AND _has_usage AND _ct > 0 "
        "THEN _ct / ((_duration - _ttft) / 1000.0D) END AS tokens_per_second",
        f"to_date(timestampadd(MICROSECOND, CAST(round(_epoch * 1000000.0D) AS BIGINT), {_EPOCH_NTZ})) AS dt",
    )


def request_log(spark: SparkSession, sf_dir: str, since: float | None = None, until: float | None = None) -> DataFrame:
    """The request log; ``since`` and ``until`` (epoch seconds) bound the scan of ``events`` itself, so that the
    bounds reach the file's row groups (the log's own time column is computed)."""
    cols = ("event_id", "ts", "user_id", "event_type", "value", "props")
    events = read_table(spark, sf_dir, "events", *cols)
    if since is not None and dict(events.dtypes)["ts"] == "timestamp_ntz":
        floor = datetime.fromtimestamp(math.floor(since), timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        events = events.filter(f"ts >= TIMESTAMP_NTZ'{floor}'")
    if until is not None and dict(events.dtypes)["ts"] == "timestamp_ntz":
        ceiling = datetime.fromtimestamp(math.ceil(until), timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        events = events.filter(f"ts <= TIMESTAMP_NTZ'{ceiling}'")
    return request_log_from_events(events)


def log_columns(df: DataFrame) -> DataFrame:
    """The 15 request-log columns, in declared order (drops ``dt``)."""
    return df.select(*LOG_COLUMNS)


def system_log_from_events(events: DataFrame) -> DataFrame:
    """System log (S3 records), one row per event."""
    return events.selectExpr(
        "event_id AS id",
        f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, CAST(ts AS TIMESTAMP_NTZ)) / 1000000.0D AS timestamp",
        "CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'ERROR' "
        "WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END AS level",
        "concat('proxy.', event_type) AS name",
        "props AS message",
        "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN concat("
        "'Traceback (most recent call last):\\n  File \"proxy\", line ', CAST(event_id % 500 AS STRING), "
        "', in forward\\nRuntimeError: ', props) END AS traceback",
    )


def system_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("event_id", "ts", "event_type", "props")
    return system_log_from_events(read_table(spark, sf_dir, "events", *cols))


def system_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The system log as it arrives: JSON lines (column ``value``) without ids. Of 50 events, one line is broken off
    and one lacks its level."""
    records = system_log(spark, sf_dir)
    return records.selectExpr(
        "CASE id % 50 WHEN 7 THEN concat('{\"timestamp\": ', CAST(id AS STRING), ', \"lev') "
        "WHEN 8 THEN to_json(struct(timestamp, name, message)) "
        "ELSE to_json(struct(timestamp, level, name, message, traceback)) END AS value")


# ----------------------------------------------------------- captured requests

def protocol_for_event(event_type: Column, event_id: Column) -> Column:
    base = _case(event_type, PROTOCOL_BY_EVENT)
    return F.when((base == "embeddings") & (event_id % 4 == 1), F.lit("embed_native")) \
        .when((base == "embeddings") & (event_id % 4 == 3), F.lit("embeddings_native")).otherwise(base)


def _prompt_words(event_type: Column, k: Column) -> Column:
    return F.trim(F.repeat(F.concat(event_type, F.lit(" ")), k.cast("int")))


PROTOCOL_SQL = ("CASE WHEN event_type IN ('click', 'error') THEN 'chat' WHEN event_type = 'view' THEN 'responses' "
                "WHEN event_type = 'signup' THEN 'messages' "
                "WHEN event_type = 'purchase' AND event_id % 4 = 1 THEN 'embed_native' "
                "WHEN event_type = 'purchase' AND event_id % 4 = 3 THEN 'embeddings_native' "
                "WHEN event_type = 'purchase' THEN 'embeddings' END")


def requests_from_events(events: DataFrame) -> DataFrame:
    """Captured request bodies, one per event (schema ``REQUESTS`` + model
    columns). Bodies are built as literal text so that the oracle can rebuild
    them byte for byte. A few bodies are malformed on purpose (F8/F9); some repeat keys (the last counts), hold
    nulls at every depth or text beyond ASCII.
    Written as SQL select lists (few driver round trips)."""
    model = sqltext.case("pmod(user_id, 6)", dict(enumerate(MODEL_BY_USER_MOD6)))
    s1 = events.selectExpr(
        "event_id", "ts", "event_type",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS _k",
        f"{PROTOCOL_SQL} AS protocol", f"{model} AS requested_model")
    s2 = s1.selectExpr(
        "event_id", "ts", "protocol", "requested_model",
        "trim(repeat(concat(event_type, ' '), CAST(_k AS INT))) AS _txt",
        "CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END AS _stream")
    s3 = s2.selectExpr(
        "*",
        """CASE WHEN event_id % 61 = 4 THEN concat('[{"role":"user","content":"', _txt, ' caf\u00e9 \u5927\u575d \U0001f600 "}]')
             WHEN event_id % 71 = 3 AND protocol = 'chat'
               THEN concat('[{"name":null,"role":"system","role":"user","content":"', _txt, '"}]')
             ELSE concat('[{"role":"user","content":"', _txt, '"}]') END AS _msgs""",
        """concat(CASE WHEN event_id % 71 = 3 THEN '{"model":"other","model":"' ELSE '{"model":"' END, requested_model, '",') AS _head""")
    body = """CASE
      WHEN event_id % 97 = 13 THEN 'not-json{'
      WHEN event_id % 89 = 7 THEN concat('{"messages":', _msgs, ',"input":"', _txt, '"}')
      WHEN event_id % 83 = 5 THEN concat('{"model":"","messages":', _msgs, ',"input":"x"}')
      WHEN protocol = 'chat' THEN concat(_head, '"messages":', _msgs, ',"stream":', _stream,
        CASE WHEN event_id % 5 = 0 THEN ',"tools":[{"type":"function","function":{"name":"lookup"}}]' ELSE '' END,
        CASE WHEN event_id % 7 = 0 THEN ',"temperature":0.5,"top_p":null' ELSE '' END,
        CASE WHEN event_id % 9 = 0 THEN ',"stream_options":{"every":250,"tag":null}' ELSE '' END,
        CASE WHEN event_id % 11 = 0 THEN ',"metadata":{"team":"north","owner":null},"stop":["\u00b6"]' ELSE '' END, '}')
      WHEN protocol = 'responses' THEN concat(_head, '"instructions":"Be brief.","input":',
        CASE WHEN event_id % 3 = 0 THEN _msgs ELSE concat('"', _txt, '"') END, ',"stream":', _stream, '}')
      WHEN protocol = 'messages' THEN concat(_head, '"max_tokens":256,"system":"You are terse.","messages":',
        _msgs, ',"stream":', _stream, '}')
      WHEN protocol = 'embeddings' THEN concat(_head, '"input":',
        CASE WHEN event_id % 4 = 0 THEN concat('["', _txt, '","', _txt, '"]') ELSE concat('"', _txt, '"') END, '}')
      ELSE concat(_head, '"input":"', _txt, '"}')
    END"""
    return s3.selectExpr(
        "event_id AS request_id", "protocol", "ts AS started_at", f"{body} AS body",
        "requested_model", "event_id % 2 = 1 AS stream")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("event_id", "ts", "user_id", "event_type", "props")
    return requests_from_events(spread(read_table(spark, sf_dir, "events", *cols)))


def responses_from_events(events: DataFrame) -> DataFrame:
    """Captured non-stream outcomes, one per event (schema ``RESPONSES``).
    Written as SQL select lists (few driver round trips)."""
    s1 = events.selectExpr(
        "event_id", "ts", "event_type", "value",
        f"{PROTOCOL_SQL} AS protocol",
        "event_id % 41 <> 0 AS _has_usage",
        "CAST(get_json_object(props, '$.k') AS BIGINT) * 10 + event_id % 7 AS _pt",
        "CASE WHEN event_type IN ('error', 'purchase') THEN CAST(0 AS BIGINT) ELSE event_id % 97 END AS _ct",
        "CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'internal' "
        "WHEN 1 THEN 'connection' ELSE 'http' END END AS failure_kind")
    s2 = s1.selectExpr(
        "*",
        "CAST(_pt AS STRING) AS _pts", "CAST(_ct AS STRING) AS _cts", "CAST(_pt + _ct AS STRING) AS _ptct",
        "CAST(floor(_pt / 2) AS BIGINT) AS _half", "CAST(floor(_pt / 4) AS BIGINT) AS _quarter",
        "CAST(floor(_pt / 8) AS BIGINT) AS _eighth",
        """CASE WHEN event_id % 2 = 0 THEN concat(',"timings":{"prompt_ms":', CAST(event_id % 1000 AS STRING),
             '.5,"predicted_per_second":', CAST(event_id % 50 + 10 AS STRING), '.25}') ELSE '' END AS _timings""")
    body = """CASE
      WHEN failure_kind = 'http' THEN CASE WHEN event_id % 2 = 0
        THEN '{"error":{"message":"tray 3 is jammed","type":"paper"}}' ELSE 'out of toner' END
      WHEN failure_kind IS NOT NULL THEN CAST(NULL AS STRING)
      WHEN event_id % 101 = 17 THEN '<html>bad gateway</html>'
      WHEN protocol = 'chat' THEN
        CASE WHEN event_id % 53 = 0 THEN '{"choices":[],"usage":{"prompt_tokens":null,"input_tokens":5,"completion_tokens":1}}'
             WHEN _has_usage THEN concat('{"id":"r","choices":[{"index":0,"message":{"role":"assistant","content":"ok"}}],',
               CASE WHEN event_id % 67 = 5 THEN '"usage":{"prompt_tokens":1},"usage":{"prompt_tokens":2,"prompt_tokens":' ELSE '"usage":{"prompt_tokens":' END, _pts, ',"completion_tokens":', _cts, ',"total_tokens":', _ptct,
               CASE WHEN event_id % 3 = 0 THEN concat(',"prompt_tokens_details":{"cached_tokens":', CAST(_half AS STRING), '}')
                    ELSE '' END, '}', _timings, '}')
             WHEN event_id % 2 = 0 THEN '{"choices":[],"usage":{}}' ELSE '{"choices":[]}' END
      WHEN protocol = 'responses' THEN
        CASE WHEN _has_usage THEN concat('{"output":[{"type":"text","text":"ok"}],"usage":{"input_tokens":', _pts,
          ',"output_tokens":', _cts,
          CASE WHEN event_id % 3 = 0 THEN concat(',"total_tokens":', _ptct, '1') ELSE '' END,
          ',"input_tokens_details":{"cached_tokens":', CAST(_half AS STRING), '}}', _timings, '}')
        ELSE '{"output":[]}' END
      WHEN protocol = 'messages' THEN
        CASE WHEN _has_usage THEN concat('{"content":[{"type":"text","text":"ok"}],"usage":{"input_tokens":', _pts,
          ',"output_tokens":', _cts, ',"cache_read_input_tokens":', CAST(_quarter AS STRING),
          ',"cache_creation_input_tokens":', CAST(_eighth AS STRING), '}}')
        ELSE '{"content":[],"usage":null}' END
      WHEN protocol = 'embeddings' THEN
        CASE WHEN _has_usage THEN concat('{"data":[],"usage":{"prompt_tokens":', _pts, ',"total_tokens":', _pts, '}}')
        ELSE '{"data":[]}' END
      ELSE CASE WHEN _has_usage THEN concat('{"embeddings":[[0.1]],"prompt_eval_count":', _pts, '}')
                ELSE '{"embeddings":[[0.1]]}' END
    END"""
    return s2.selectExpr(
        "event_id AS request_id",
        "timestampadd(MICROSECOND, CAST(floor(value * 10000.0D) AS BIGINT), ts) AS ended_at",
        "CAST(CASE WHEN event_type = 'error' THEN CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 500 WHEN 1 THEN 502 "
        "ELSE 429 END ELSE 200 END AS INT) AS status_code",
        "failure_kind", f"{body} AS body")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ("event_id", "ts", "event_type", "value", "props")
    return responses_from_events(spread(read_table(spark, sf_dir, "events", *cols)))


# ------------------------------------------------- catalog dims from TPC-H tables

SUPPLIER_URL_SQL = ("concat('http://s', CAST(s_suppkey AS STRING), ':8080', "
                    "CASE CAST(pmod(s_suppkey, 3) AS INT) WHEN 0 THEN '' WHEN 1 THEN '/' ELSE '/v1/' END)")


def catalog_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backends derived from ``supplier``: every supplier in good standing
    (non-negative account balance) is a configured backend; suppliers in debt
    stay referenced by mappings but unconfigured (orphan entries). Suppliers of
    nation 0 also have a mirror entry re-using their id (a duplicate id: the
    later entry wins in the catalog). Schema ``BACKENDS``."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").filter("s_acctbal >= 0")
    main = s.selectExpr(
        "2 * s_suppkey AS pos", "concat('b', CAST(s_suppkey AS STRING)) AS id",
        f"{SUPPLIER_URL_SQL} AS url",
        "CAST(CASE WHEN s_nationkey % 4 = 0 THEN NULL ELSE (s_nationkey + 1) * 1024 END AS INT) AS context_size")
    mirror = s.filter("s_nationkey = 0").selectExpr(
        "2 * s_suppkey + 1 AS pos", "concat('b', CAST(s_suppkey AS STRING)) AS id",
        "concat('http://mirror', CAST(s_suppkey AS STRING), ':8080') AS url", "CAST(512 AS INT) AS context_size")
    return main.unionByName(mirror)


def catalog_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured ``/props`` documents, one per supplier; those of even nations
    carry ``default_generation_settings.n_ctx``. Schema ``BACKEND_PROPS``."""
    s = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return s.selectExpr(
        f"concat(regexp_replace(regexp_replace({SUPPLIER_URL_SQL}, '/+$', ''), '/v1$', ''), '/props') AS props_url",
        """CASE WHEN s_nationkey % 2 = 0 THEN concat('{"default_generation_settings":{"n_ctx":',
             CAST((s_nationkey + 1) * 2048 AS STRING), '}}') ELSE '{"default_generation_settings":{}}' END AS json""")


def catalog_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings without their backends, one per part: position = part key, model id from brand and
    size class (so ids repeat and the first mapping must win)."""
    return read_table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size").selectExpr(
        "CAST(p_partkey AS BIGINT) AS pos",
        "concat('m-', lower(regexp_replace(p_brand, 'Brand#', '')), '-', CAST(p_size % 5 AS STRING)) AS model_id")


def catalog_mappings(spark: SparkSession, sf_dir: str, heads: DataFrame | None = None) -> DataFrame:
    """Model mappings: the ``heads`` (default: every part) with the part's suppliers in ``lineitem``,
    ascending, as backends. Lines of other parts leave before the one shuffle of
    ``lineitem``, and (part, supplier) pairs are made distinct before they become arrays."""
    heads = catalog_heads(spark, sf_dir) if heads is None else heads
    pairs = read_table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey") \
        .selectExpr("CAST(l_partkey AS BIGINT) AS pos", "l_suppkey") \
        .join(heads.select("pos"), "pos", "left_semi").distinct()
    per_part = pairs.groupBy("pos").agg(F.expr("array_sort(collect_list(l_suppkey)) AS _s"))
    return heads.join(per_part, "pos", "left").selectExpr(
        "pos", "model_id",
        "transform(coalesce(_s, CAST(array() AS array<bigint>)), x -> concat('b', CAST(x AS STRING))) AS backend_ids")


def catalog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as JSON lines (column ``value``), one per backend and mapping. By position mod 31, lines
    are cut short (3), lack a field (4) or hold a value of another type (5)."""
    fault = "CASE pmod(pos, 31) WHEN 3 THEN substr({0}, 1, 20) WHEN 4 THEN {1} WHEN 5 THEN {2} ELSE {0} END AS value"
    b = catalog_backends(spark, sf_dir).selectExpr("*", "'backend' AS kind").selectExpr(fault.format(
        "to_json(struct(kind, pos, id, url, context_size))", "to_json(struct(kind, pos, id, context_size))",
        "to_json(struct(kind, pos, id, url, 'much' AS context_size))"))
    m = catalog_mappings(spark, sf_dir).selectExpr("*", "'mapping' AS kind").selectExpr(fault.format(
        "to_json(struct(kind, pos, model_id, backend_ids))", "to_json(struct(kind, pos, backend_ids))",
        "to_json(struct(kind, pos, model_id, 'b1' AS backend_ids))"))
    return b.unionByName(m)


# fixed values: catalog defaults of the derived configuration
CATALOG_DEFAULT_MODEL = "m-13-0"
CATALOG_DEFAULT_EMBEDDING_MODEL = "m-21-2"


# ------------------------------------------------ captured SSE streams (conversations)

# fixed values: stream fixture layout
STREAM_PROTOCOL_BY_CONV_MOD3 = ["chat", "responses", "messages"]
STREAM_EPOCH = "TIMESTAMP_NTZ'2024-02-01 00:00:00'"
SEQ_FIRST_DELTA = 10
SEQ_USAGE = 1 << 40         # beyond the words of any text
SEQ_DONE = SEQ_USAGE + 1
#: one number for a conversation and a turn: pairs are counted along their diagonals, so that no two share one
STREAM_ID = "((conv_id + turn) * (conv_id + turn + 1) div 2 + turn)"
STREAM_START = f"timestampadd(SECOND, CAST(request_id % 100000000 AS INT), {STREAM_EPOCH})"
# how failed streams end, by conv_id div 21 mod 3: text and code
STREAM_ERRORS = [("Backend HTTP 429: queue is full", 429), ("Connection error (ConnectTimeout): no answer", 502),
                 ("Internal proxy stream error (ValueError): bad chunk", 500)]
STREAM_ERROR_KIND = "pmod(conv_id div 21, 3)"


def _json_str(c: Column) -> Column:
    """JSON string literal of a string column."""
    arr = F.to_json(F.array(c))
    return arr.substr(F.lit(2), F.length(arr) - 2)


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One streamed request per assistant turn: request_id counts the pairs (conv_id, turn),
    protocol by conv_id mod 3, prompt = the preceding turn's text. The previous
    turn is found with an equi-join on (conv_id, turn), which hash-partitions
    on both keys, so one very long conversation is spread over many tasks."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    asst = conv.filter("role = 'assistant'").select("conv_id", "turn")
    prev = conv.selectExpr("conv_id AS p_conv", "turn + 1 AS p_turn", "text AS prev_text")
    j = asst.join(prev, (asst.conv_id == prev.p_conv) & (asst.turn == prev.p_turn), "left")
    proto = sqltext.case("pmod(conv_id, 3)", dict(enumerate(STREAM_PROTOCOL_BY_CONV_MOD3)))
    model = sqltext.case("pmod(conv_id, 6)", dict(enumerate(MODEL_BY_USER_MOD6)))
    staged = j.selectExpr(
        f"{STREAM_ID} AS request_id", f"{proto} AS protocol", f"{model} AS requested_model",
        f"""concat('[{{"role":"user","content":', {_json_str_sql("coalesce(prev_text, '')")}, '}}]') AS _msgs""")
    return staged.selectExpr(
        "request_id", "protocol",
        f"{STREAM_START} AS started_at",
        """CASE WHEN protocol = 'responses'
             THEN concat('{"model":"', requested_model, '","input":', _msgs, ',"stream":true}')
             ELSE concat('{"model":"', requested_model, '","messages":', _msgs, ',"stream":true}') END AS body""",
        "requested_model")


def _json_str_sql(x: str) -> str:
    """SQL: JSON string literal of the string expression ``x``."""
    return f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)"


def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured SSE lines (schema ``SSE_LINES``) for every assistant turn: a
    non-data line, a malformed data line, dialect-specific text deltas (one
    per word), an optional usage chunk and ``[DONE]``. Usage is present iff
    conv_id mod 4 <> 0; streams with conv_id mod 7 = 3 fail: no usage chunk,
    and the proxy's error event (P25; backend, connection or internal) replaces the clean end.
    arrival_ts = request start + offset(seq) ms. Written as SQL select lists."""
    conv = spread(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    proto = sqltext.case("pmod(conv_id, 3)", dict(enumerate(STREAM_PROTOCOL_BY_CONV_MOD3)))
    a = conv.filter("role = 'assistant'").selectExpr(
        f"{STREAM_ID} AS request_id", f"{proto} AS protocol",
        "conv_id", "conv_id % 4 <> 0 AS has_usage", "conv_id % 7 = 3 AS fails",
        "CAST(length(text) AS BIGINT) AS n", "split(text, ' ') AS w")
    a = a.selectExpr("*", "CAST(size(w) AS BIGINT) AS nw")
    usage_line = f"""CASE WHEN has_usage AND NOT fails THEN CASE
        WHEN protocol = 'chat' THEN concat('data: {{"choices":[],"usage":{{"prompt_tokens":', CAST(n AS STRING),
          ',"completion_tokens":', CAST(nw AS STRING), ',"total_tokens":', CAST(n + nw AS STRING), '}}}}')
        WHEN protocol = 'responses' THEN concat('data: {{"type":"response.completed","response":{{"usage":{{"input_tokens":',
          CAST(n AS STRING), ',"output_tokens":', CAST(nw AS STRING), '}}}}}}')
        ELSE concat('data: {{"type":"message_delta","usage":{{"output_tokens":', CAST(nw AS STRING), '}}}}') END END"""
    start_line = f"""CASE WHEN protocol = 'messages' AND has_usage THEN
        concat('data: {{"type":"message_start","message":{{"usage":{{"input_tokens":', CAST(n AS STRING),
          ',"output_tokens":1,"cache_read_input_tokens":', CAST(CAST(floor(n / 4) AS BIGINT) AS STRING), '}}}}}}') END"""
    plain = sqltext.case(STREAM_ERROR_KIND, {
        k: 'data: {"error":{"message":"%s","type":"api_error"}}' % t for k, (t, _) in enumerate(STREAM_ERRORS)})
    coded = sqltext.case(STREAM_ERROR_KIND, {
        k: 'data: {"error":{"message":"%s","type":"api_error","code":%d}}' % e for k, e in enumerate(STREAM_ERRORS)})
    end_line = f"CASE WHEN NOT fails THEN 'data: [DONE]' WHEN protocol = 'messages' THEN 'event: error' ELSE {coded} END"
    after_end = f"CASE WHEN fails THEN CASE WHEN protocol = 'messages' THEN {plain} ELSE 'data: [DONE]' END END"
    fixed = a.selectExpr("request_id", "protocol", "nw", f"""inline(array(
        named_struct('seq', CAST(1 AS BIGINT), 'line', 'event: start'),
        named_struct('seq', CAST(2 AS BIGINT), 'line', 'data: half a line'),
        named_struct('seq', CAST(3 AS BIGINT), 'line', {start_line}),
        named_struct('seq', CAST({SEQ_USAGE} AS BIGINT), 'line', {usage_line}),
        named_struct('seq', CAST({SEQ_DONE} AS BIGINT), 'line', {end_line}),
        named_struct('seq', CAST({SEQ_DONE + 1} AS BIGINT), 'line', {after_end})))""").filter("line IS NOT NULL")
    words = a.selectExpr("request_id", "protocol", "nw", "posexplode(w) AS (i, word)")
    d = _json_str_sql("CASE WHEN i = 0 THEN word ELSE concat(' ', word) END")
    delta_line = f"""CASE
        WHEN protocol = 'chat' THEN concat('data: {{"choices":[{{"index":0,"delta":{{"content":', {d}, '}}}}]}}')
        WHEN protocol = 'responses' THEN concat('data: {{"type":"response.output_text.delta","delta":', {d}, '}}')
        ELSE concat('data: {{"type":"content_block_delta","index":0,"delta":{{"type":"text_delta","text":', {d}, '}}}}')
      END"""
    deltas = words.selectExpr("request_id", "protocol", "nw", f"CAST(i + {SEQ_FIRST_DELTA} AS BIGINT) AS seq",
                              f"{delta_line} AS line")
    lines = fixed.unionByName(deltas)
    return lines.selectExpr(
        "request_id", "protocol", "seq",
        f"timestampadd(MILLISECOND, CASE WHEN seq < {SEQ_USAGE} THEN seq ELSE nw + 20 + (seq - {SEQ_USAGE}) END, "
        f"{STREAM_START}) AS arrival_ts",
        "line")
