"""Oracle SQL: captured responses, usage normalisation, errors, log build."""

from __future__ import annotations

from ..operators.finalize import (CONNECTION_DETAIL, DECODE_DETAIL, INTERNAL_DETAIL,
                                  INVALID_USAGE_DETAIL)
from .o_routing import DEMO_DIMS, LIMIT_CTE, REQ_CTE, ROUTE_CTE
from .oracle import ORACLE

RESP_CTE = """
rs_k AS (
  SELECT event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN event_type IN ('click', 'error') THEN 'chat' WHEN event_type = 'view' THEN 'responses'
         WHEN event_type = 'signup' THEN 'messages'
         WHEN event_id % 4 = 1 THEN 'embed_native' WHEN event_id % 4 = 3 THEN 'embeddings_native' ELSE 'embeddings' END AS protocol
  FROM events
),
rs_u AS (
  SELECT *, (event_id % 41 <> 0) AS has_usage, k * 10 + event_id % 7 AS pt,
    CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE event_id % 97 END AS ct,
    CASE WHEN event_id % 2 = 0 THEN ',"timings":{"prompt_ms":' || CAST(event_id % 1000 AS VARCHAR) ||
      '.5,"predicted_per_second":' || CAST(event_id % 50 + 10 AS VARCHAR) || '.25}' ELSE '' END AS timings,
    CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'internal' WHEN 1 THEN 'connection' ELSE 'http' END END AS failure_kind
  FROM rs_k
),
responses AS (
  SELECT event_id AS request_id,
    ts + to_microseconds(CAST(floor(value * 10000.0) AS BIGINT)) AS ended_at,
    CAST(CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 502 ELSE 429 END
              ELSE 200 END AS INTEGER) AS status_code,
    failure_kind,
    CASE
      WHEN failure_kind = 'http' THEN CASE WHEN event_id % 2 = 0
        THEN '{"error":{"message":"tray 3 is jammed","type":"paper"}}' ELSE 'out of toner' END
      WHEN failure_kind IS NOT NULL THEN NULL
      WHEN event_id % 101 = 17 THEN '<html>bad gateway</html>'
      WHEN protocol = 'chat' THEN
        CASE WHEN event_id % 53 = 0 THEN '{"choices":[],"usage":{"prompt_tokens":null,"input_tokens":5,"completion_tokens":1}}'
             WHEN has_usage THEN '{"id":"r","choices":[{"index":0,"message":{"role":"assistant","content":"ok"}}],' ||
               '"usage":{"prompt_tokens":' || CAST(pt AS VARCHAR) || ',"completion_tokens":' || CAST(ct AS VARCHAR) ||
               ',"total_tokens":' || CAST(pt + ct AS VARCHAR) ||
               CASE WHEN event_id % 3 = 0 THEN ',"prompt_tokens_details":{"cached_tokens":' || CAST(pt // 2 AS VARCHAR) || '}' ELSE '' END ||
               '}' || timings || '}'
             WHEN event_id % 2 = 0 THEN '{"choices":[],"usage":{}}' ELSE '{"choices":[]}' END
      WHEN protocol = 'responses' THEN
        CASE WHEN has_usage THEN '{"output":[{"type":"text","text":"ok"}],"usage":{"input_tokens":' || CAST(pt AS VARCHAR) ||
          ',"output_tokens":' || CAST(ct AS VARCHAR) ||
          CASE WHEN event_id % 3 = 0 THEN ',"total_tokens":' || CAST(pt + ct AS VARCHAR) || '1' ELSE '' END ||
          ',"input_tokens_details":{"cached_tokens":' || CAST(pt // 2 AS VARCHAR) || '}}' || timings || '}'
        ELSE '{"output":[]}' END
      WHEN protocol = 'messages' THEN
        CASE WHEN has_usage THEN '{"content":[{"type":"text","text":"ok"}],"usage":{"input_tokens":' || CAST(pt AS VARCHAR) ||
          ',"output_tokens":' || CAST(ct AS VARCHAR) || ',"cache_read_input_tokens":' || CAST(pt // 4 AS VARCHAR) ||
          ',"cache_creation_input_tokens":' || CAST(pt // 8 AS VARCHAR) || '}}'
        ELSE '{"content":[],"usage":null}' END
      WHEN protocol = 'embeddings' THEN
        CASE WHEN has_usage THEN '{"data":[],"usage":{"prompt_tokens":' || CAST(pt AS VARCHAR) ||
          ',"total_tokens":' || CAST(pt AS VARCHAR) || '}}' ELSE '{"data":[]}' END
      ELSE CASE WHEN has_usage THEN '{"embeddings":[[0.1]],"prompt_eval_count":' || CAST(pt AS VARCHAR) || '}'
                ELSE '{"embeddings":[[0.1]]}' END
    END AS body
  FROM rs_u
)"""

# input: a relation "fin_in" with request_id, protocol, est, status_code, failure_kind, body
FIN_CTE = f"""
fin_a AS (
  SELECT fin_in.*, CASE WHEN body IS NOT NULL AND json_valid(body) THEN body END AS jd FROM fin_in
),
fin_b AS (
  SELECT *,
    jd IS NOT NULL AS decodable,
    (json_type(jd, '$.usage') = 'OBJECT' AND CAST(json_extract(jd, '$.usage') AS VARCHAR) <> '{{}}') AS u_present,
    json_type(jd, '$.usage.prompt_tokens') IS NOT NULL AS p_has,
    json_type(jd, '$.usage.input_tokens') IS NOT NULL AS i_has,
    json_type(jd, '$.usage.completion_tokens') IS NOT NULL AS c_has,
    json_type(jd, '$.usage.output_tokens') IS NOT NULL AS o_has,
    json_type(jd, '$.usage.total_tokens') IS NOT NULL AS t_has,
    TRY_CAST(json_extract(jd, '$.usage.prompt_tokens') AS BIGINT) AS p_v,
    TRY_CAST(json_extract(jd, '$.usage.input_tokens') AS BIGINT) AS i_v,
    TRY_CAST(json_extract(jd, '$.usage.completion_tokens') AS BIGINT) AS c_v,
    TRY_CAST(json_extract(jd, '$.usage.output_tokens') AS BIGINT) AS o_v,
    TRY_CAST(json_extract(jd, '$.usage.total_tokens') AS BIGINT) AS t_v
  FROM fin_a
),
fin_c AS (
  SELECT *,
    CASE WHEN p_has THEN p_v WHEN i_has THEN i_v ELSE CAST(est AS BIGINT) END AS up,
    CASE WHEN c_has THEN c_v WHEN o_has THEN o_v ELSE 0 END AS uc
  FROM fin_b
),
fin_d AS (
  SELECT *, CASE WHEN t_has THEN t_v ELSE up + uc END AS ut FROM fin_c
),
fin_e AS (
  SELECT *,
    CASE WHEN protocol IN ('embed_native', 'embeddings_native') THEN true
         WHEN u_present THEN (up IS NOT NULL AND uc IS NOT NULL AND ut IS NOT NULL)
         ELSE true END AS u_valid
  FROM fin_d
),
fin AS (
  SELECT request_id, protocol,
    CAST(CASE WHEN failure_kind = 'http' THEN status_code WHEN failure_kind = 'connection' THEN 502
         WHEN failure_kind IS NOT NULL THEN 500 WHEN NOT decodable OR NOT u_valid THEN 500
         ELSE status_code END AS INTEGER) AS final_status,
    (failure_kind IS NULL AND decodable AND u_valid) AS good,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid THEN
      CASE WHEN protocol IN ('embed_native', 'embeddings_native') THEN coalesce(TRY_CAST(json_extract(jd, '$.prompt_eval_count') AS BIGINT), 0)
           WHEN u_present THEN up ELSE CAST(est AS BIGINT) END
      ELSE CAST(est AS BIGINT) END AS prompt_tokens,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid AND protocol NOT IN ('embed_native', 'embeddings_native') AND u_present
      THEN uc ELSE 0 END AS completion_tokens,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid THEN
      CASE WHEN protocol IN ('embed_native', 'embeddings_native') THEN coalesce(TRY_CAST(json_extract(jd, '$.prompt_eval_count') AS BIGINT), 0)
           WHEN u_present THEN ut ELSE CAST(est AS BIGINT) END
      ELSE CAST(est AS BIGINT) END AS total_tokens,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid AND protocol NOT IN ('embed_native', 'embeddings_native') AND u_present
      THEN TRY_CAST(json_extract(jd, '$.usage.prompt_tokens_details.cached_tokens') AS BIGINT) END AS prompt_cached_tokens,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid AND protocol NOT IN ('embed_native', 'embeddings_native') AND u_present
      THEN TRY_CAST(json_extract(jd, '$.usage.cache_creation_input_tokens') AS BIGINT) END AS cache_creation_input_tokens,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid AND protocol NOT IN ('embed_native', 'embeddings_native') AND u_present
      THEN TRY_CAST(json_extract(jd, '$.usage.cache_read_input_tokens') AS BIGINT) END AS cache_read_input_tokens,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid
      THEN TRY_CAST(json_extract(jd, '$.timings.prompt_ms') AS DOUBLE) END AS ttft_ms,
    CASE WHEN failure_kind IS NULL AND decodable AND u_valid
      THEN TRY_CAST(json_extract(jd, '$.timings.predicted_per_second') AS DOUBLE) END AS tokens_per_second,
    CASE WHEN failure_kind = 'http' THEN 'Backend HTTP ' || CAST(status_code AS VARCHAR) || ': ' || coalesce(body, '')
         WHEN failure_kind = 'connection' THEN '{CONNECTION_DETAIL}'
         WHEN failure_kind IS NOT NULL THEN '{INTERNAL_DETAIL}'
         WHEN NOT decodable THEN '{DECODE_DETAIL}'
         WHEN NOT u_valid THEN '{INVALID_USAGE_DETAIL}' END AS error_message
  FROM fin_e
)"""

USAGE_SELECT = """SELECT request_id, protocol, final_status, prompt_tokens, completion_tokens, total_tokens,
  prompt_cached_tokens, cache_creation_input_tokens, cache_read_input_tokens, ttft_ms, tokens_per_second,
  error_message FROM fin"""


def _usage(protocols: list[str]) -> str:
    ps = ", ".join(f"'{p}'" for p in protocols)
    return f"""WITH {REQ_CTE}, {RESP_CTE},
fin_in AS (
  SELECT req.request_id, req.protocol, req.prompt_tokens AS est, r.status_code, r.failure_kind, r.body
  FROM req JOIN responses r ON r.request_id = req.request_id
), {FIN_CTE}
{USAGE_SELECT} WHERE protocol IN ({ps})"""


ORACLE.update({
    "usage_chat": _usage(["chat"]),
    "usage_responses": _usage(["responses"]),
    "usage_messages": _usage(["messages"]),
    "usage_embed": _usage(["embeddings", "embed_native", "embeddings_native"]),
    "error_normalise": f"""WITH {REQ_CTE}, {RESP_CTE},
e AS (SELECT r.request_id, req.protocol, r.status_code, r.body,
        CASE WHEN json_valid(r.body) THEN r.body END AS jb
      FROM responses r JOIN req ON req.request_id = r.request_id WHERE r.failure_kind = 'http'),
e2 AS (SELECT *, (json_type(jb) = 'OBJECT' AND json_type(jb, '$.error') IS NOT NULL) AS passes FROM e)
SELECT request_id, protocol, status_code,
  CASE WHEN passes THEN body
       WHEN protocol <> 'messages' THEN '{{"error":{{"message":' || CAST(to_json(body) AS VARCHAR) || ',"type":"api_error","code":' || CAST(status_code AS VARCHAR) || '}}}}'
       ELSE '{{"error":{{"message":' || CAST(to_json(body) AS VARCHAR) || ',"type":"api_error"}}}}' END AS error_payload,
  CASE WHEN passes THEN coalesce(CASE WHEN json_type(jb, '$.error') = 'OBJECT' THEN json_extract_string(jb, '$.error.message') END, body)
       ELSE body END AS error_detail
FROM e2""",
    "log_build": f"""WITH {REQ_CTE}, {DEMO_DIMS}, {ROUTE_CTE}, {LIMIT_CTE}, {RESP_CTE},
lreq AS (
  SELECT l.*, CAST(CASE WHEN limit_exceeded THEN 400 ELSE route_status END AS INTEGER) AS limit_status, q.started_at
  FROM limited2 l JOIN req q ON q.request_id = l.request_id
),
lreq2 AS (SELECT * FROM lreq WHERE limit_status NOT IN (400, 422) OR limit_exceeded),
fin_in AS (
  SELECT lreq2.request_id, lreq2.protocol, lreq2.prompt_tokens AS est, r.status_code, r.failure_kind, r.body
  FROM lreq2 LEFT JOIN responses r ON r.request_id = lreq2.request_id
), {FIN_CTE},
lg AS (
  SELECT q.request_id AS id,
    CASE WHEN q.limit_status = 200 THEN CAST(epoch_us(r.ended_at) AS DOUBLE) / 1000000.0
         ELSE CAST(epoch_us(q.started_at) AS DOUBLE) / 1000000.0 END AS "timestamp",
    q.logged_model AS model_id,
    CASE WHEN q.limit_status = 200 THEN q.target_url WHEN q.limit_exceeded THEN q.backend_root_url ELSE 'N/A' END AS backend_url,
    CAST(CASE WHEN q.limit_status = 200 THEN f.final_status ELSE q.limit_status END AS INTEGER) AS status_code,
    CASE WHEN q.limit_status = 200 THEN (epoch_us(r.ended_at) - epoch_us(q.started_at)) / 1000.0 ELSE 0.0 END AS duration_ms,
    CASE WHEN q.limit_status = 200 THEN f.prompt_tokens WHEN q.limit_exceeded THEN CAST(q.prompt_tokens AS BIGINT) END AS prompt_tokens,
    CASE WHEN q.limit_status = 200 THEN f.completion_tokens WHEN q.limit_exceeded THEN 0 END AS completion_tokens,
    CASE WHEN q.limit_status = 200 THEN f.total_tokens WHEN q.limit_exceeded THEN CAST(q.prompt_tokens AS BIGINT) END AS total_tokens,
    CASE WHEN q.limit_status = 200 THEN f.prompt_cached_tokens END AS prompt_cached_tokens,
    CASE WHEN q.limit_status = 200 THEN f.cache_creation_input_tokens END AS cache_creation_input_tokens,
    CASE WHEN q.limit_status = 200 THEN f.cache_read_input_tokens END AS cache_read_input_tokens,
    CASE WHEN q.limit_status = 200 THEN f.error_message WHEN q.limit_exceeded THEN q.limit_message
         WHEN q.limit_status = 404 THEN 'Model ''' || q.requested_model || ''' is not mapped to any backends and no valid default model is configured.'
         ELSE 'No configured backends found for model ''' || q.requested_model || '''.' END AS error_message,
    CASE WHEN q.limit_status = 200 THEN f.ttft_ms END AS ttft_ms,
    CASE WHEN q.limit_status = 200 THEN f.tokens_per_second END AS tokens_per_second
  FROM lreq2 q JOIN fin f ON f.request_id = q.request_id LEFT JOIN responses r ON r.request_id = q.request_id
)
SELECT * FROM lg WHERE model_id NOT IN ('orphan-model', 'unmapped-model')""",
})

ORACLE["log_build_bucketed"] = ORACLE["log_build"]
