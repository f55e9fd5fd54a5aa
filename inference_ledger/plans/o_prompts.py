"""Oracle SQL: prompt texts, token estimates, validation, payload normalisation."""

from __future__ import annotations

from ..functions.tokens import PIECE_PATTERN
from .o_routing import REQ_CTE
from .oracle import ORACLE

PIECE = PIECE_PATTERN.replace("'", "''")


def _prompt(protocols: list[str]) -> str:
    ps = ", ".join(f"'{p}'" for p in protocols)
    return f"""WITH {REQ_CTE}
SELECT request_id, protocol, reject_reason, ptext AS prompt_text, CAST(prompt_tokens AS BIGINT) AS prompt_tokens
FROM req WHERE protocol IN ({ps})"""


ORACLE.update({
    "prompt_text_chat": _prompt(["chat"]),
    "prompt_text_responses": _prompt(["responses"]),
    "prompt_text_messages": _prompt(["messages"]),
    "prompt_text_embeddings": _prompt(["embeddings", "embed_native", "embeddings_native"]),
    "token_estimate": f"""
SELECT source, grp, count(*) AS texts,
  CAST(sum(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE len(regexp_extract_all(text, '{PIECE}')) END) AS BIGINT) AS token_estimate
FROM (SELECT 'conversations' AS source, role AS grp, text FROM conversations
      UNION ALL SELECT 'documents', lang, text FROM documents)
GROUP BY ALL""",
    "request_validate": f"""WITH {REQ_CTE}
SELECT request_id, protocol, reject_reason, CAST(reject_status AS INTEGER) AS reject_status FROM req""",
    "payload_normalise": f"""WITH {REQ_CTE},
pn AS (
  -- the writer spells characters beyond U+FFFF as two escapes
  SELECT request_id, protocol, replace(replace(body, ',"top_p":null', ''), '😀', '\\uD83D\\uDE00') AS b,
    protocol IN ('chat', 'responses') AND coalesce(TRY_CAST(json_extract(jb, '$.stream') AS BOOLEAN), false) AS force
  FROM rq_j WHERE protocol IN ('chat', 'responses', 'messages') AND json_type(jb) = 'OBJECT'
)
SELECT request_id, protocol,
  CASE WHEN NOT force THEN b
       WHEN contains(b, '"stream_options":{{"every":250,"tag":null}}')
         THEN replace(b, '"tag":null}}', '"tag":null,"include_usage":true}}')
       ELSE left(b, length(b) - 1) || ',"stream_options":{{"include_usage":true}}}}' END AS payload
FROM pn""",
    "content_flatten": f"""
SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS chars,
  CAST(CASE WHEN text = '' THEN 0 ELSE len(regexp_extract_all(text, '{PIECE}')) END AS BIGINT) AS tokens
FROM conversations""",
})
