"""Oracle SQL: views."""

from __future__ import annotations

from . import params as P
from .oracle import AS_OF, LOG_CTE, ORACLE, R, SYSLOG_CTE, _measures, _since

LOG_COLS = ("id, \"timestamp\", model_id, backend_url, status_code, duration_ms, prompt_tokens, "
            "completion_tokens, total_tokens, prompt_cached_tokens, cache_creation_input_tokens, "
            "cache_read_input_tokens, error_message, ttft_ms, tokens_per_second")


def ts_text(col: str) -> str:
    return f"strftime(make_timestamp(CAST(round({col} * 1000000.0) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


def fixed(x: str, d: int) -> str:
    s = 10 ** d
    scaled = f"CAST(round(abs({x}) * {s}.0) AS BIGINT)"
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST({scaled} // {s} AS VARCHAR) || '.' || "
            f"lpad(CAST({scaled} % {s} AS VARCHAR), {d}, '0'))")


def thousands(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN '--' ELSE format('{{:,}}', CAST({x} AS BIGINT)) END)"


def fixed_or_dash(x: str, d: int, suffix: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR {x} = 0 THEN '--' ELSE {fixed(x, d)} || '{suffix}' END)"


def _page(limit: int, offset: int) -> str:
    return f"""WITH {LOG_CTE}
SELECT {LOG_COLS} FROM log ORDER BY "timestamp" DESC, id DESC LIMIT {limit} OFFSET {offset}"""


def _log_view(limit: int, offset: int) -> str:
    return f"""WITH {LOG_CTE},
page AS (SELECT * FROM log ORDER BY "timestamp" DESC, id DESC LIMIT {limit} OFFSET {offset})
SELECT id, "timestamp", {ts_text('"timestamp"')} AS timestamp_formatted, model_id, backend_url, status_code,
  CASE WHEN status_code = 200 THEN 'success' ELSE 'error' END AS status_class,
  {fixed_or_dash('ttft_ms', 1, 'ms')} AS ttft_display,
  {thousands('total_tokens')} AS tokens_display,
  {fixed('duration_ms', 2)} || ' ms' AS latency_display,
  {fixed_or_dash('tokens_per_second', 1, ' t/s')} AS speed_display,
  CASE WHEN error_message IS NULL OR error_message = '' THEN 'OK'
       WHEN length(error_message) > 100 THEN substring(error_message, 1, 100) || '...'
       ELSE error_message END AS details,
  {'true' if offset > 0 else 'false'} AS has_prev,
  (count(*) OVER () = {limit}) AS has_next
FROM page"""


def _totals_cte(where: str) -> str:
    return f"""t0 AS (SELECT count(*) AS total_requests, {_measures()} FROM log {where}),
t AS (SELECT total_requests,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_input_tokens END AS total_input_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_output_tokens END AS total_output_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_tokens END AS total_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_cached_tokens END AS total_cached_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_compute_burn END AS total_compute_burn,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_ttft_ms END AS avg_ttft_ms,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_duration_ms END AS avg_duration_ms,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_tokens_per_second END AS avg_tokens_per_second
FROM t0)"""


# display columns of the stats view are computed from the unrounded averages
def _stats_view(caption: str, where: str) -> str:
    raw = _measures().replace(f"round(avg(ttft_ms), {R})", "avg(ttft_ms)") \
        .replace(f"round(avg(duration_ms), {R})", "avg(duration_ms)") \
        .replace(f"round(avg(tokens_per_second), {R})", "avg(tokens_per_second)")
    return f"""WITH {LOG_CTE},
t0 AS (SELECT count(*) AS total_requests, {raw} FROM log {where}),
t AS (SELECT total_requests,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_input_tokens END AS total_input_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_output_tokens END AS total_output_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_tokens END AS total_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_cached_tokens END AS total_cached_tokens,
  CASE WHEN total_requests = 0 THEN 0 ELSE total_compute_burn END AS total_compute_burn,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_ttft_ms END AS avg_ttft_ms,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_duration_ms END AS avg_duration_ms,
  CASE WHEN total_requests = 0 THEN 0.0 ELSE avg_tokens_per_second END AS avg_tokens_per_second
FROM t0)
SELECT '{caption}' AS caption, total_requests, total_input_tokens, total_output_tokens, total_tokens,
  total_cached_tokens, total_compute_burn,
  round(avg_ttft_ms, {R}) AS avg_ttft_ms, round(avg_duration_ms, {R}) AS avg_duration_ms,
  round(avg_tokens_per_second, {R}) AS avg_tokens_per_second,
  {thousands('total_requests')} AS requests_display,
  {thousands('total_tokens')} AS tokens_display,
  {thousands('total_compute_burn')} AS burn_display,
  {thousands('total_input_tokens')} AS input_display,
  {thousands('total_input_tokens - total_cached_tokens')} AS regular_input_display,
  {thousands('total_cached_tokens')} AS cached_display,
  {thousands('total_output_tokens')} AS output_display,
  {fixed_or_dash('avg_ttft_ms', 2, ' ms')} AS ttft_display,
  CASE WHEN avg_duration_ms IS NULL THEN '--' ELSE {fixed('avg_duration_ms', 2)} || ' ms' END AS latency_display,
  {fixed_or_dash('avg_tokens_per_second', 2, ' t/s')} AS speed_display
FROM t"""


_MODEL_RAW = f"""m AS (SELECT model_id, count(*) AS "count",
    CAST(sum(prompt_tokens) AS BIGINT) AS total_input_tokens,
    CAST(sum(completion_tokens) AS BIGINT) AS total_output_tokens,
    CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
    CAST(sum(coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS total_cached_tokens,
    CAST(sum(total_tokens - (coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0))) AS BIGINT) AS total_compute_burn,
    avg(ttft_ms) AS avg_ttft_ms, avg(duration_ms) AS avg_duration_ms, avg(tokens_per_second) AS avg_tokens_per_second
  FROM log GROUP BY model_id)"""

ORACLE.update({
    "recent_logs_page": _page(P.RECENT_LIMIT, P.RECENT_OFFSET),
    "recent_logs_page3": _page(P.RECENT_LIMIT, 2 * P.RECENT_LIMIT),
    "recent_logs_keyset": f"""WITH {LOG_CTE}
SELECT {LOG_COLS} FROM log WHERE "timestamp" < {AS_OF - 24 * 3600!r}
ORDER BY "timestamp" DESC, id DESC LIMIT {P.RECENT_LIMIT}""",
    "all_logs": f"""WITH {LOG_CTE}
SELECT {LOG_COLS} FROM log ORDER BY "timestamp" DESC, id DESC""",
    "system_logs_topk": f"""WITH {SYSLOG_CTE}
SELECT * FROM syslog ORDER BY "timestamp" DESC, id DESC LIMIT {P.SYSTEM_LOG_LIMIT}""",
    "log_view": _log_view(P.LOG_PAGE_LIMIT, 0),
    "log_view_page2": _log_view(P.LOG_PAGE_LIMIT, P.LOG_PAGE_LIMIT),
    "system_log_view": f"""WITH {SYSLOG_CTE}
SELECT id, "timestamp", {ts_text('"timestamp"')} AS timestamp_formatted, level,
  level IN ('ERROR', 'CRITICAL') AS is_error, name, message, traceback
FROM syslog ORDER BY "timestamp" DESC, id DESC LIMIT {P.SYSTEM_LOG_PAGE_LIMIT}""",
    "stats_view": _stats_view("all time", ""),
    "stats_view_day": _stats_view("day", _since(24)),
    "model_cards": f"""WITH {LOG_CTE}, {_MODEL_RAW}
SELECT model_id, "count", total_input_tokens, total_output_tokens, total_tokens, total_cached_tokens,
  total_compute_burn, round(avg_ttft_ms, {R}) AS avg_ttft_ms, round(avg_duration_ms, {R}) AS avg_duration_ms,
  round(avg_tokens_per_second, {R}) AS avg_tokens_per_second,
  {thousands('"count"')} AS requests_display,
  {thousands('total_tokens')} AS tokens_display,
  {thousands('total_compute_burn')} AS burn_display,
  {thousands('total_input_tokens')} AS input_display,
  {thousands('total_input_tokens - total_cached_tokens')} AS regular_input_display,
  {thousands('total_cached_tokens')} AS cached_display,
  {thousands('total_output_tokens')} AS output_display,
  {fixed_or_dash('avg_ttft_ms', 2, ' ms')} AS ttft_display,
  {fixed_or_dash('avg_duration_ms', 2, ' ms')} AS latency_display,
  {fixed_or_dash('avg_tokens_per_second', 2, ' t/s')} AS speed_display
FROM m ORDER BY "count" DESC, model_id""",
    "untracked_filtered": f"""WITH {LOG_CTE}
SELECT {LOG_COLS} FROM log WHERE model_id NOT IN ('orphan-model', 'unmapped-model')""",
})
