"""Oracle SQL: SSE folds in closed form (no SSE parsing needed).

The fixture writes one text delta per word, so the folded text is the turn's
text; usage (when present) is n = length(text) prompt tokens and one
completion token per word; the first-token line is seq 10 (or the first
non-empty word for the responses dialect, which skips empty deltas). Failed
streams count no text (T19) but keep usage seen before the failure (the
messages dialect's message_start: n prompt, 1 completion).
"""

from __future__ import annotations

from ..functions.tokens import PIECE_PATTERN
from ..sources.derive import MODEL_BY_USER_MOD6, SEQ_FIRST_DELTA, STREAM_ERRORS
from .q_sse import PART_LINES
from . import o_usage  # noqa: F401  (its statement of plain calls is part of one here)
from .oracle import ORACLE, _measures

PIECE = PIECE_PATTERN.replace("'", "''")

_ERROR_TEXT = " ".join(f"WHEN {k} THEN '{t}'" for k, (t, _) in enumerate(STREAM_ERRORS))
_ERROR_CODE = " ".join(f"WHEN {k} THEN {c}" for k, (_, c) in enumerate(STREAM_ERRORS))

STREAM_CTE = f"""
sa AS (
  SELECT c.conv_id, c.turn, c.text, p.text AS prev_text,
    CAST((c.conv_id + c.turn) * (c.conv_id + c.turn + 1) // 2 + c.turn AS BIGINT) AS request_id,
    CASE c.conv_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'responses' ELSE 'messages' END AS protocol,
    (c.conv_id % 4 <> 0 AND c.conv_id % 7 <> 3) AS has_usage,
    (c.conv_id % 7 = 3) AS fails,
    (c.conv_id % 3 = 2 AND c.conv_id % 4 <> 0 AND c.conv_id % 7 = 3) AS start_usage_only,
    CAST(length(c.text) AS BIGINT) AS n,
    string_split(c.text, ' ') AS w
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn + 1 = c.turn
  WHERE c.role = 'assistant'
),
sb AS (
  SELECT *, CAST(len(w) AS BIGINT) AS nw,
    '[{{"role": "user", "content": ' || array_to_string(list_transform(
      string_split(CAST(to_json(coalesce(prev_text, '')) AS VARCHAR), ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN c ELSE '\\u' || format('{{:04x}}', unicode(c)) END), '') || '}}]' AS ptext,
    CASE WHEN protocol <> 'responses' THEN 1
         WHEN w[1] <> '' THEN 1 WHEN len(w) > 1 THEN 2 END AS first_idx
  FROM sa
),
sc AS (
  SELECT *,
    len(regexp_extract_all(ptext, '{PIECE}')) AS est,
    CASE WHEN fails OR text = '' THEN 0 ELSE len(regexp_extract_all(text, '{PIECE}')) END AS counted,
    CAST(20 + nw + CASE WHEN fails THEN 2 ELSE 1 END AS DOUBLE) AS duration_ms,
    CASE WHEN first_idx IS NULL THEN NULL ELSE CAST(10 + first_idx - 1 AS DOUBLE) END AS ttft_ms
  FROM sb
),
sd AS (
  SELECT request_id, conv_id, protocol, text, w, fails,
    CASE WHEN fails THEN CASE conv_id // 21 % 3 {_ERROR_TEXT} END END AS error_message,
    CAST(CASE WHEN fails THEN CASE conv_id // 21 % 3 {_ERROR_CODE} END ELSE 200 END AS INTEGER) AS status_code,
    CAST(CASE WHEN has_usage OR start_usage_only THEN n ELSE est END AS BIGINT) AS prompt_tokens,
    CAST(CASE WHEN has_usage THEN nw WHEN start_usage_only THEN 1 ELSE counted END AS BIGINT) AS completion_tokens,
    CAST(CASE WHEN has_usage THEN n + nw WHEN start_usage_only THEN n + 1 ELSE est + counted END AS BIGINT) AS total_tokens,
    CAST(CASE WHEN (has_usage OR start_usage_only) AND protocol = 'messages' THEN n // 4 END AS BIGINT) AS cache_read_input_tokens,
    ttft_ms, duration_ms
  FROM sc
)"""


#: the words of a text by the part that their line falls in; a part of empty words alone is none
PARTS = f"""parts AS (
  SELECT request_id, part, string_agg(piece, '' ORDER BY i) AS ptext FROM (
    SELECT request_id, i, CAST(({SEQ_FIRST_DELTA} + i) // {PART_LINES} AS BIGINT) AS part,
      CASE WHEN i = 0 THEN w[1] ELSE ' ' || w[i + 1] END AS piece
    FROM (SELECT request_id, w, unnest(range(len(w))) AS i FROM sd))
  WHERE piece <> '' GROUP BY ALL)"""


def sse_rows(where: str) -> str:
    return f"""WITH {STREAM_CTE}, {PARTS}
SELECT sd.request_id, coalesce(part, CAST(0 AS BIGINT)) AS part, coalesce(ptext, '') AS text, prompt_tokens, completion_tokens,
  total_tokens, cache_read_input_tokens, ttft_ms, duration_ms,
  CASE WHEN ttft_ms IS NOT NULL AND duration_ms > ttft_ms AND completion_tokens > 0
       THEN completion_tokens / ((duration_ms - ttft_ms) / 1000.0) END AS tokens_per_second,
  error_message
FROM sd LEFT JOIN parts ON parts.request_id = sd.request_id {where}"""


def _sse(protocol: str) -> str:
    return sse_rows(f"WHERE protocol = '{protocol}'")


_MODEL = " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MODEL_BY_USER_MOD6))

_BY_STATUS = """model_id, status_code, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(error_message) AS errors"""
_PLAIN_CALLS = ORACLE["log_build"].removeprefix("WITH ").rsplit("SELECT * FROM lg WHERE", 1)[0]

ORACLE["log_build_all"] = f"""WITH {STREAM_CTE}, {_PLAIN_CALLS},
every_call AS (
  SELECT model_id, status_code, prompt_tokens, total_tokens, error_message FROM lg
  WHERE model_id NOT IN ('orphan-model', 'unmapped-model')
  UNION ALL SELECT CASE conv_id % 6 {_MODEL} END, status_code, prompt_tokens, total_tokens, error_message FROM sd)
SELECT {_BY_STATUS} FROM every_call GROUP BY ALL"""

ORACLE.update({
    "log_build_streams": f"""WITH {STREAM_CTE},
log AS (
  SELECT CASE conv_id % 6 {_MODEL} END AS model_id, prompt_tokens, completion_tokens, total_tokens,
    CAST(NULL AS BIGINT) AS prompt_cached_tokens, cache_read_input_tokens, ttft_ms, duration_ms,
    CASE WHEN ttft_ms IS NOT NULL AND duration_ms > ttft_ms AND completion_tokens > 0
         THEN completion_tokens / ((duration_ms - ttft_ms) / 1000.0) END AS tokens_per_second
  FROM sd)
SELECT model_id, count(*) AS "count", {_measures()} FROM log GROUP BY model_id ORDER BY "count" DESC, model_id""",
    "sse_chat": _sse("chat"),
    "sse_responses": _sse("responses"),
    "sse_messages": _sse("messages"),
    "sse_errors": f"""WITH {STREAM_CTE}
SELECT protocol, NOT (fails AND protocol = 'messages') AS saw_done, fails AS saw_error, count(*) AS requests
FROM sd GROUP BY ALL""",
})
