"""Oracle SQL: storage round trips and streaming twins (same answers as the
batch operators they mirror)."""

from __future__ import annotations

from .o_routing import DEMO_DIMS, LIMIT_CTE, REQ_CTE, ROUTE_CTE
from .o_sse import sse_rows
from .o_views import LOG_COLS
from . import params as P
from .oracle import LOG_CTE, ORACLE, SYSLOG_CTE, R

CUTOFF = 1705276800.0
LATER = ("prompt_cached_tokens", "cache_creation_input_tokens", "cache_read_input_tokens", "error_message",
         "ttft_ms", "tokens_per_second")


def _evolved_cols() -> str:
    out = []
    for c in LOG_COLS.split(", "):
        name = c.strip('"')
        if name in LATER:
            out.append(f'CASE WHEN "timestamp" >= {CUTOFF!r} THEN {c} END AS {c}')
        else:
            out.append(c)
    return ", ".join(out)


ORACLE.update({
    "stored_totals_day": ORACLE["totals_day"],
    "evolve_schema": f"WITH {LOG_CTE}\nSELECT {_evolved_cols()} FROM log",
    "clear_tables": """SELECT 'request_log' AS table_name, count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM events
UNION ALL SELECT 'system_log', count(*), CAST(0 AS BIGINT) FROM events""",
    "system_log_ingest": f"""WITH {SYSLOG_CTE}
SELECT level, name, count(*) AS records, count(traceback) AS with_traceback FROM syslog GROUP BY ALL""",
    "export_json": f"""WITH {LOG_CTE}
SELECT (SELECT count(*) FROM log) AS total_requests, model_id, count(*) AS "count",
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  CAST(sum(total_tokens - (coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0))) AS BIGINT) AS total_compute_burn
FROM log GROUP BY model_id""",
    "export_logs_page": ORACLE["recent_logs_page"],
    "stream_append": f"WITH {LOG_CTE}\nSELECT {LOG_COLS} FROM log",
    "stream_totals": ORACLE["totals_all"],
    "stream_recent": ORACLE["recent_logs_page"],
    "stream_series": f"""WITH {LOG_CTE}
SELECT strftime(make_timestamp(CAST(round("timestamp" * 1000000.0) AS BIGINT)), '%Y-%m-%d %H:00') AS label,
  count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens,
  CAST(sum(coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS cached_tokens
FROM log GROUP BY 1""",
    "stream_series_day": f"""WITH {LOG_CTE}
SELECT strftime(make_timestamp(CAST(round("timestamp" * 1000000.0) AS BIGINT)), '%Y-%m-%d') AS label,
  count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens,
  CAST(sum(coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS cached_tokens
FROM log GROUP BY 1""",
    "stream_series_month": f"""WITH {LOG_CTE}
SELECT strftime(make_timestamp(CAST(round("timestamp" * 1000000.0) AS BIGINT)), '%Y-%m') AS label,
  count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens,
  CAST(sum(coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0)) AS BIGINT) AS cached_tokens
FROM log GROUP BY 1""",
    "stream_sse": sse_rows(""),
    "stream_route": f"""WITH {REQ_CTE}, {DEMO_DIMS}, {ROUTE_CTE}, {LIMIT_CTE}
SELECT request_id, protocol, resolved_model, backend_id,
  CAST(CASE WHEN limit_exceeded THEN 400 ELSE route_status END AS INTEGER) AS limit_status,
  CASE WHEN NOT limit_exceeded AND route_status = 200 THEN 'accepted' ELSE 'rejected' END AS outcome
FROM limited2""",
})
_ = R

ORACLE["stream_system_recent"] = ORACLE["system_logs_topk"]
ORACLE["stream_finished"] = ORACLE["stream_sse"]
ORACLE["stream_system_ingest"] = f"""WITH {SYSLOG_CTE},
good AS (SELECT * FROM syslog WHERE id % 50 NOT IN (7, 8))
SELECT 'stored' AS kind, level, name, count(*) AS records, count(traceback) AS with_traceback, CAST(NULL AS BIGINT) AS id_span
FROM good GROUP BY level, name
UNION ALL SELECT 'ids', NULL, NULL, count(*), count(traceback), count(*) FROM good
UNION ALL SELECT 'quarantined', NULL, NULL, count(*), NULL, NULL FROM syslog WHERE id % 50 IN (7, 8)"""
ORACLE["log_ids"] = f"""WITH {LOG_CTE}
SELECT count(*) AS requests, count(*) AS distinct_ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM log"""
ORACLE["recent_logs_deep"] = f"""WITH {LOG_CTE}
SELECT {LOG_COLS} FROM log ORDER BY "timestamp" DESC, id DESC LIMIT {P.RECENT_LIMIT} OFFSET {P.DEEP_OFFSET}"""
ORACLE["export_models"] = ORACLE["totals_and_models"]
ORACLE["export_series"] = " UNION ALL ".join(
    f"SELECT *, '{p}' AS period FROM ({ORACLE['series_' + p]})" for p in ("hour", "day", "month"))
