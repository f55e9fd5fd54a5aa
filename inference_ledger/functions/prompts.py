"""Prompt text of a captured request body (P15-P18), request validity (F8,
F9) and payload normalisation (P26, P27).

Sub-documents are taken with ``get_json_object``, which keeps the original key
order and writes compact JSON, and spelled as Python spells them (``", "``, ``": "``, ASCII escapes;
T9), since the prompt is counted over that text. A list ``system`` is spelled as JSON, not as
a Python ``repr``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NATIVE_PROTOCOLS
from .jsontext import canonical, last_wins, members, python_json, written
from .tokens import estimate_tokens


def parsed(body: Column) -> Column:
    return F.try_parse_json(body)


def kind(v: Column, path: str) -> Column:
    """Type name of the value at ``path`` (NULL when absent)."""
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def present(v: Column, path: str) -> Column:
    """Key presence: TRUE for an explicit JSON null, FALSE for a missing path (T4)."""
    return F.variant_get(v, path, "variant").isNotNull()


def json_of(body: Column, path: str) -> Column:
    return F.get_json_object(body, path)


def _quoted(s: Column) -> Column:
    """JSON string literal of ``s``."""
    arr = F.to_json(F.array(s))
    return arr.substr(F.lit(2), F.length(arr) - 2)


# chat messages whose fields are already in a record's order, none null
PLAIN_MESSAGES = r'^\[(?:\{"role":"(?:[^"\\]++|\\.)*+"(?:,"content":"(?:[^"\\]++|\\.)*+")?\},?)*+\]$'


PROMPT_FIELDS = ("messages", "tools", "input", "system")


def prompt_text(protocol: Column, body: Column, v: Column | None = None,
                fields: dict[str, Column] | None = None) -> Column:
    """Text whose tokens estimate the prompt, per protocol. ``v`` is the body
    parsed once (``with_parsed``); ``fields`` are the raw JSON texts of the
    top-level ``PROMPT_FIELDS`` taken by one ``json_tuple`` pass
    (``with_prompt_fields``). Without them each field is re-read from the body."""
    v = parsed(body) if v is None else v

    def raw(name: str) -> Column:
        return fields[name] if fields else json_of(body, "$." + name)

    tools = F.coalesce(python_json(raw("tools")), F.lit(""))
    messages = F.coalesce(python_json(raw("messages")), F.lit("[]"))
    inp_kind = kind(v, "$.input")
    inp_json = raw("input")
    inp_str = F.try_variant_get(v, "$.input", "string")
    # responses: str(instructions) + json(input) + json(tools); a string input is JSON-quoted
    responses = F.concat(
        F.coalesce(F.try_variant_get(v, "$.instructions", "string"), F.lit("")),
        F.coalesce(python_json(F.when(inp_kind == "STRING", _quoted(inp_str)).otherwise(inp_json)), F.lit("")),
        tools)
    # messages: json(messages) + str(system) + json(tools)
    system_kind = kind(v, "$.system")
    system = F.when(system_kind == "STRING", F.try_variant_get(v, "$.system", "string")) \
        .otherwise(F.coalesce(python_json(raw("system")), F.lit("")))
    msgs = F.concat(messages, system, tools)
    # embeddings: string as-is; list of strings joined by newline; else JSON
    first_is_str = kind(v, "$.input[0]") == "STRING"
    emb = (F.when(inp_kind == "STRING", inp_str)
           .when(inp_kind.startswith("ARRAY") & first_is_str,
                 F.array_join(F.from_json(inp_json, "array<string>"), "\n"))
           .otherwise(F.coalesce(python_json(inp_json), F.lit("null"))))
    return (F.when(v.isNull(), F.lit(""))
            .when(protocol == "chat", F.concat(messages, tools))
            .when(protocol == "responses", responses)
            .when(protocol == "messages", msgs)
            .when(protocol == "embeddings", emb)
            .otherwise(F.lit("")))


def prompt_estimate(protocol: Column, body: Column, v: Column | None = None,
                    fields: dict[str, Column] | None = None) -> Column:
    """Native prompt-token estimate; the native embedding passthrough counts 0."""
    v = parsed(body) if v is None else v
    return F.when(protocol.isin(*NATIVE_PROTOCOLS) | v.isNull(), F.lit(0).cast("bigint")) \
        .otherwise(estimate_tokens(prompt_text(protocol, body, v, fields)))


PARSED = "_body_v"
FIELD_PREFIX = "_raw_"


def with_parsed(df, body: str = "body"):
    """Adds the body parsed once as VARIANT (column ``_body_v``; of a repeated key, the last value) and the raw
    JSON text of the top-level prompt fields from one ``json_tuple`` pass
    (columns ``_raw_<field>``). Messages of a chat are records: role and content first, null fields dropped."""
    names = [FIELD_PREFIX + f for f in PROMPT_FIELDS]
    one = last_wins(df, body, PARSED, "_text")
    raw = one.select("*", F.json_tuple(F.col("_text"), *PROMPT_FIELDS).alias(*names)).drop("_text")
    if "protocol" not in df.columns:
        return raw
    name = FIELD_PREFIX + "messages"
    plain = PLAIN_MESSAGES.replace("\\", "\\\\")
    doc = f"""concat('{{"messages":', get_json_object({name}, '$'), '}}')"""
    return raw.withColumn(name, F.expr(
        f"IF(protocol = 'chat' AND NOT {name} RLIKE '{plain}', coalesce({members(doc, 'false', 'true')}.vals[0], {name}), {name})"))


def with_estimate(df, body: str = "body", out: str = "prompt_tokens"):
    """``df`` with the prompt-token estimate of its captured requests (columns protocol and ``body``)."""
    estimate = prompt_estimate(F.col("protocol"), F.col(body), F.col(PARSED), parsed_fields())
    return with_parsed(df, body).withColumn(out, estimate).select(*[c for c in df.columns if c != out], out)


def parsed_fields() -> dict[str, Column]:
    return {f: F.col(FIELD_PREFIX + f) for f in PROMPT_FIELDS}


# fixed values: texts and numbers that count as booleans
BOOLEAN_TEXTS = ("true", "false", "t", "f", "yes", "no", "y", "n", "on", "off", "1", "0")


def reject_reason(protocol: Column, body: Column, v: Column | None = None) -> Column:
    """F8 + F9: NULL for a valid request, else the first failing rule."""
    v = parsed(body) if v is None else v
    model_kind = F.coalesce(kind(v, "$.model"), F.lit(""))
    model = F.try_variant_get(v, "$.model", "string")
    is_obj = F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT")
    msgs_ok = F.coalesce(kind(v, "$.messages"), F.lit("")).startswith("ARRAY")
    input_kind = F.coalesce(kind(v, "$.input"), F.lit("VOID"))
    input_present = input_kind != "VOID"
    native = protocol.isin(*NATIVE_PROTOCOLS)

    def kind_of(x: Column, path: str = "$") -> Column:
        return F.coalesce(F.schema_of_variant(F.variant_get(x, path, "variant")), F.lit("VOID"))

    def elements(path: str) -> Column:
        return F.try_variant_get(v, path, "array<variant>")

    def objects(path: str) -> Column:
        return F.coalesce(F.forall(elements(path), lambda x: kind_of(x).startswith("OBJECT")), F.lit(False))

    # chat messages: a role text, and content as text, list of objects, or none
    turns = F.coalesce(F.forall(elements("$.messages"), lambda m: kind_of(m).startswith("OBJECT")
                                & (kind_of(m, "$.role") == "STRING")
                                & (kind_of(m, "$.content").isin("VOID", "STRING")
                                   | (kind_of(m, "$.content").startswith("ARRAY") & F.coalesce(F.forall(
                                       F.try_variant_get(m, "$.content", "array<variant>"),
                                       lambda p: kind_of(p).startswith("OBJECT")), F.lit(False))))), F.lit(False))
    stream_kind = kind_of(v, "$.stream")
    stream_ok = stream_kind.isin("VOID", "BOOLEAN") | F.coalesce(
        F.lower(F.try_variant_get(v, "$.stream", "string")).isin(*BOOLEAN_TEXTS), F.lit(False))
    input_ok = (input_kind.isin("VOID", "STRING") | (input_kind.startswith("ARRAY") & objects("$.input")))
    return (F.when(v.isNull() | ~is_obj, F.lit("invalid_json"))
            .when(native & (model.isNull() | (model == "")), F.lit("missing_model"))
            .when(~native & (model_kind != "STRING"), F.lit("missing_model"))
            .when(protocol.isin("chat", "messages") & ~msgs_ok, F.lit("missing_messages"))
            .when((protocol == "embeddings") & ~input_present, F.lit("missing_input"))
            .when((protocol == "chat") & ~turns, F.lit("invalid_messages"))
            .when((protocol == "messages") & ~objects("$.messages"), F.lit("invalid_messages"))
            .when((protocol == "responses") & ~input_ok, F.lit("invalid_input"))
            .when((protocol == "embeddings") & ~(input_kind == "STRING") & ~input_kind.startswith("ARRAY"),
                  F.lit("invalid_input"))
            .when(protocol.isin("chat", "responses", "messages") & ~stream_ok, F.lit("invalid_stream")))


def reject_status(reason: Column, protocol: Column) -> Column:
    """400 for the native passthrough's own checks, 422 for schema validation."""
    return (F.when(reason.isNull(), F.lit(None).cast("int"))
            .when(protocol.isin(*NATIVE_PROTOCOLS), F.lit(400))
            .otherwise(F.lit(422)))


def with_payload(df, body: str = "body", messages: str = "false", force: str = "false", out: str = "payload"):
    """P26 + P27: the body as it is forwarded (column ``out``, JSON text in its own order; NULL if it is no JSON object). Null
    fields of the request are dropped, and where ``messages`` holds (chat, whose messages are records too)
    those of each message; values inside free-form objects (tools, content parts, items) stay. Where ``force``
    holds, ``stream_options.include_usage`` is true: added, or overwritten in an object; other
    values are left alone. ``messages`` and ``force`` are SQL conditions."""
    usage = "'\"include_usage\"'"
    # each step is bound to a lambda's variable: as columns, the optimizer would write every fold many times over
    def bound(value: str, name: str, then: str) -> str:
        return f"transform(array({value}), {name} -> {then})[0]"

    at = "CAST(array_position(m.keys, '\"stream_options\"') AS INT)"
    own = "CASE WHEN p.at > 0 AND element_at(p.m.vals, p.at) LIKE '{%' THEN element_at(p.m.vals, p.at) END"
    options = f"""IF(array_contains(o.keys, {usage}),
        named_struct('keys', o.keys, 'vals', zip_with(o.keys, o.vals, (k, v) -> IF(k = {usage}, 'true', v))),
        named_struct('keys', concat(o.keys, array({usage})), 'vals', concat(o.vals, array('true'))))"""
    replaced = bound(f"IF(q.text IS NULL, NULL, {members('q.text')})", "o", f"IF(o IS NULL, NULL, {bound(options, 'n', written('n'))})")
    forced = f"""CASE WHEN NOT ({force}) OR p.m IS NULL THEN p.m
        WHEN p.at = 0 THEN named_struct('keys', concat(p.m.keys, array('"stream_options"')),
          'vals', concat(p.m.vals, array('{{"include_usage":true}}')))
        ELSE {bound(f"named_struct('text', {own})", "q", bound(replaced, "r", """IF(r IS NULL, p.m, named_struct('keys', p.m.keys,
          'vals', transform(p.m.vals, (v, i) -> IF(i + 1 = p.at, r, v))))"""))} END"""
    whole = bound(members(canonical(body), "true", messages), "m", bound(
        f"named_struct('m', m, 'at', {at})", "p", bound(forced, "w", written("w"))))
    return df.withColumn(out, F.expr(whole))
