"""DuckDB oracle SQL for the registered queries.

Each statement restates, in plain SQL over the pre-registered views, both the
derivation of the capture tables (``sources/derive.py``) and the operator under
test. Column names match the Spark results; DuckDB's HUGEINT sums are cast to
BIGINT and averages are rounded the same way as on the Spark side.
"""

from __future__ import annotations

from . import params as P

R = P.ROUND_DIGITS
AS_OF = P.AS_OF_EPOCH

LOG_CTE = """
log_k AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
),
log_u AS (
  SELECT *, (event_id % 41 <> 0) AS has_usage, k * 10 + event_id % 7 AS pt,
         CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE event_id % 97 END AS ct,
         CAST(CASE WHEN event_type = 'error'
                   THEN CASE event_id % 3 WHEN 0 THEN 500 WHEN 1 THEN 502 ELSE 429 END
                   ELSE 200 END AS INTEGER) AS status,
         value * 10.0 AS dur,
         CASE WHEN event_type <> 'error' AND event_id % 2 = 0 THEN value * 2.5 END AS ttft
  FROM log_k
),
log AS (
  SELECT event_id AS id,
    CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 AS "timestamp",
    CASE user_id % 6 WHEN 0 THEN 'chat-large' WHEN 1 THEN 'chat-medium' WHEN 2 THEN 'chat-small'
      WHEN 3 THEN 'embed-text' WHEN 4 THEN 'unmapped-model' ELSE 'orphan-model' END AS model_id,
    'http://h' || CAST(user_id % 4 + 1 AS VARCHAR) || ':8080' ||
      CASE event_type WHEN 'click' THEN '/v1/chat/completions' WHEN 'error' THEN '/v1/chat/completions'
        WHEN 'view' THEN '/v1/responses' WHEN 'signup' THEN '/v1/messages'
        WHEN 'purchase' THEN '/v1/embeddings' END AS backend_url,
    status AS status_code,
    dur AS duration_ms,
    CASE WHEN has_usage THEN pt END AS prompt_tokens,
    CASE WHEN has_usage THEN ct END AS completion_tokens,
    CASE WHEN has_usage THEN pt + ct END AS total_tokens,
    CASE WHEN has_usage AND event_id % 3 = 0 THEN pt // 2 END AS prompt_cached_tokens,
    CASE WHEN has_usage AND event_id % 11 = 0 THEN pt // 8 END AS cache_creation_input_tokens,
    CASE WHEN has_usage AND event_id % 5 = 0 THEN pt // 4 END AS cache_read_input_tokens,
    CASE status
      WHEN 500 THEN 'Internal error (RuntimeError): upstream closed the stream before the final chunk was received; partial output discarded (props ' || props || ')'
      WHEN 502 THEN 'Connection error (ConnectError): all connection attempts failed'
      WHEN 429 THEN 'Backend HTTP 429: {"error":{"message":"tray 1 is empty","type":"paper"}}'
    END AS error_message,
    ttft AS ttft_ms,
    CASE WHEN ttft IS NOT NULL AND dur > ttft AND has_usage AND ct > 0
         THEN ct / ((dur - ttft) / 1000.0) END AS tokens_per_second
  FROM log_u
)"""

SYSLOG_CTE = """
syslog AS (
  SELECT event_id AS id,
    CAST(epoch_us(ts) AS DOUBLE) / 1000000.0 AS "timestamp",
    CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'CRITICAL'
         WHEN event_type = 'error' THEN 'ERROR'
         WHEN event_type = 'signup' THEN 'WARNING' ELSE 'INFO' END AS level,
    'proxy.' || event_type AS name,
    props AS message,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN
      'Traceback (most recent call last):' || chr(10) || '  File "proxy", line ' ||
      CAST(event_id % 500 AS VARCHAR) || ', in forward' || chr(10) || 'RuntimeError: ' || props
    END AS traceback
  FROM events
)"""


def _measures(round_avg: bool = True) -> str:
    return f"""
    CAST(sum(prompt_tokens) AS BIGINT) AS total_input_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS total_cached_tokens,
    CAST(sum(total_tokens - (coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0))) AS BIGINT) AS total_compute_burn,
    round(avg(ttft_ms), {R}) AS avg_ttft_ms,
    round(avg(duration_ms), {R}) AS avg_duration_ms,
    round(avg(tokens_per_second), {R}) AS avg_tokens_per_second"""


def _totals(where: str) -> str:
    return f"""WITH {LOG_CTE},
t AS (SELECT count(*) AS total_requests, {_measures()} FROM log {where})
SELECT total_requests,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_input_tokens END AS total_input_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_output_tokens END AS total_output_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_tokens END AS total_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_cached_tokens END AS total_cached_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_compute_burn END AS total_compute_burn,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_ttft_ms END AS avg_ttft_ms,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_duration_ms END AS avg_duration_ms,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_tokens_per_second END AS avg_tokens_per_second
FROM t"""


def _since(hours: int, as_of: float = AS_OF) -> str:
    return f'WHERE "timestamp" >= {as_of - hours * 3600!r}'


def _series(fmt: str, window_s: int) -> str:
    return f"""WITH {LOG_CTE}
SELECT strftime(make_timestamp(CAST(round("timestamp" * 1000000.0) AS BIGINT)), '{fmt}') AS label,
  count(*) AS requests,
  CAST(sum(total_tokens) AS BIGINT) AS tokens,
  CAST(sum(coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS cached_tokens
FROM log WHERE "timestamp" >= {AS_OF - window_s!r}
GROUP BY 1 ORDER BY 1"""


ORACLE: dict[str, str] = {
    "totals_all": _totals(""),
    "totals_hour": _totals(_since(1)),
    "totals_day": _totals(_since(24)),
    "totals_month": _totals(_since(720)),
    "totals_empty": _totals(_since(1, AS_OF + 365 * 24 * 3600)),
    "model_rollup": f"""WITH {LOG_CTE}
SELECT model_id, count(*) AS "count", {_measures()} FROM log GROUP BY model_id ORDER BY "count" DESC, model_id""",
    "model_rollup_day": f"""WITH {LOG_CTE}
SELECT model_id, count(*) AS "count", {_measures()} FROM log {_since(24)} GROUP BY model_id ORDER BY "count" DESC, model_id""",
    "totals_and_models": f"""WITH {LOG_CTE}
SELECT CASE WHEN grouping(model_id) = 1 THEN 'total' ELSE 'model' END AS level,
  model_id, count(*) AS requests, {_measures()}
FROM log GROUP BY GROUPING SETS ((), (model_id))""",
    "series_hour": _series("%Y-%m-%d %H:00", 24 * 3600),
    "series_day": _series("%Y-%m-%d", 30 * 24 * 3600),
    "series_month": _series("%Y-%m", 365 * 24 * 3600),
    "series_unknown": f"""WITH {LOG_CTE}
SELECT CAST(NULL AS VARCHAR) AS label, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens,
  CAST(sum(total_tokens) AS BIGINT) AS cached_tokens FROM log WHERE false GROUP BY 1""",
}


def all_oracles() -> dict[str, str]:
    from . import o_views, o_routing, o_usage, o_sse, o_prompts, o_sources  # noqa: F401  (each adds its statements)
    return dict(ORACLE)
