"""Non-stream finalisation and the request-log build: A17, J8, P6, P23, P24, S2.

``finalize_responses`` turns captured responses into usage / timing / error
columns. ``build_log`` joins routed requests to their outcome on
``request_id`` (a shuffle join of two large capture tables; no broadcast) and
projects the request-log schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import usage as U
from ..functions.jsontext import last_wins
from ..functions.timefmt import duration_ms, epoch_date, epoch_seconds
from ..schemas import LOG_COLUMNS, NATIVE_PROTOCOLS
from ..session import checked_broadcast

# fixed values: error texts for failures without a backend body
CONNECTION_DETAIL = "Connection error (ConnectError): all connection attempts failed"
INTERNAL_DETAIL = "Internal error (RuntimeError): backend stream aborted"
DECODE_DETAIL = "Internal error (JSONDecodeError): Expecting value: line 1 column 1 (char 0)"
NOT_AN_OBJECT_DETAIL = "Internal error (AttributeError): the body is not a JSON object"
NO_TIMINGS_DETAIL = "Internal error (AttributeError): timings is not a JSON object"
INVALID_USAGE_DETAIL = "Internal error (ValidationError): invalid usage record"
NOT_MAPPED_TEXT = "Model '%s' is not mapped to any backends and no valid default model is configured."
NO_BACKENDS_TEXT = "No configured backends found for model '%s'."
USAGE_COLS = ["prompt_tokens", "completion_tokens", "total_tokens", "prompt_cached_tokens",
              "cache_creation_input_tokens", "cache_read_input_tokens"]


def backend_error_payload(body: Column, status: Column, include_code: Column) -> tuple[Column, Column]:
    """A JSON object carrying ``error`` passes through; anything else is
    wrapped as ``api_error`` (with ``code`` for the OpenAI dialects). Returns
    (payload JSON text, detail text = error.message else the raw body)."""
    v = F.try_parse_json(body)
    is_obj = U.vkind(v).startswith("OBJECT")
    err = U.vget(v, "$.error")
    passes = is_obj & err.isNotNull()
    wrapped = F.when(include_code, F.to_json(F.struct(F.struct(
        body.alias("message"), F.lit("api_error").alias("type"), status.alias("code")).alias("error")))) \
        .otherwise(F.to_json(F.struct(F.struct(body.alias("message"), F.lit("api_error").alias("type")).alias("error"))))
    payload = F.when(passes, body).otherwise(wrapped)
    err_msg = F.when(U.vkind(err).startswith("OBJECT") & U.has(err, "$.message"),
                     F.try_variant_get(err, "$.message", "string"))
    detail = F.when(passes, F.coalesce(err_msg, body)).otherwise(body)
    return payload, detail


def finalize_responses(joined: DataFrame, estimate: str = "prompt_tokens") -> DataFrame:
    """A17 over rows carrying ``protocol``, the prompt estimate and the
    response columns (status_code, failure_kind, body). Adds final_status,
    the six usage columns, ttft_ms, tokens_per_second, error_message.

    Three projections: parse once, extract, decide. Spark does not collapse a
    projection when that would duplicate a non-trivial expression, so each
    stage generates small code and the body is parsed once."""
    if estimate != "_est":
        joined = joined.withColumn("_est", F.col(estimate))
    base = [c for c in joined.columns if c not in USAGE_COLS]
    parsed = last_wins(joined.select(*base), "body", "_data", "_text").drop("_text")
    data = F.col("_data")
    est = F.col("_est").cast("bigint")
    native = F.col("protocol").isin(*NATIVE_PROTOCOLS)
    oa = U.openai_usage(data, est)
    nu = U.native_embed_usage(data)
    ttft, tps = U.timings(data)
    extracted = parsed.select(
        *base,
        *[F.when(native, nu[k]).otherwise(oa[k]).alias("_u_" + k) for k in oa],
        (U.vkind(data) != "").alias("_decodable"), U.vkind(data).startswith("OBJECT").alias("_object"),
        F.coalesce(U.timings_fail(data), F.lit(False)).alias("_bad_timings"), ttft.alias("_ttft"), tps.alias("_tps"))
    valid = F.col("_u_usage_valid")
    decodable = F.col("_decodable")
    kind = F.col("failure_kind")
    read = kind.isNull() & F.col("_object") & valid         # the usage has been read
    good = read & ~F.col("_bad_timings")
    status = (F.when(kind == "http", F.col("status_code"))
              .when(kind == "connection", F.lit(502))
              .when(kind.isNotNull(), F.lit(500))
              .when(~good, F.lit(500))
              .otherwise(F.col("status_code"))).cast("int")
    error = (F.when(kind == "http",
                    F.concat(F.lit("Backend HTTP "), F.col("status_code").cast("string"), F.lit(": "),
                             F.coalesce(F.col("body"), F.lit(""))))
             .when(kind == "connection", F.lit(CONNECTION_DETAIL))
             .when(kind.isNotNull(), F.lit(INTERNAL_DETAIL))
             .when(~decodable, F.lit(DECODE_DETAIL))
             .when(~F.col("_object"), F.lit(NOT_AN_OBJECT_DETAIL))
             .when(~valid, F.lit(INVALID_USAGE_DETAIL))
             .when(F.col("_bad_timings"), F.lit(NO_TIMINGS_DETAIL)))
    # on a failure before the usage is read it falls back to (estimate, 0, estimate)
    fallback = {"prompt_tokens": est, "completion_tokens": F.lit(0).cast("bigint"), "total_tokens": est}
    return extracted.select(
        *base,
        status.alias("final_status"),
        *[F.when(read, F.col("_u_" + c)).otherwise(fallback.get(c, F.lit(None).cast("bigint"))).alias(c)
          for c in USAGE_COLS],
        F.when(good, F.col("_ttft")).alias("ttft_ms"),
        F.when(good, F.col("_tps")).alias("tokens_per_second"),
        error.alias("error_message"),
    )


# fixed values: how the texts of failed streams begin
BACKEND_TEXT, CONNECTION_TEXT = r"^Backend HTTP ([0-9]{3})", "Connection error ("
CLASS_TEXT = r"^(?:Connection error|Internal proxy stream error|Internal error) \(([A-Za-z0-9_.]+)\)"


def failure_status(code: Column, text: Column) -> Column:
    """Status of a failed stream: the code that its error event carries (the backend's own, 502 or 500), else, in the
    dialect without codes, what its text says; 500 for anything else."""
    backend = F.regexp_extract(F.coalesce(text, F.lit("")), BACKEND_TEXT, 1).try_cast("int")
    return F.coalesce(F.when(code.between(400, 599), code), backend,
                      F.when(text.startswith(CONNECTION_TEXT), F.lit(502)), F.lit(500)).cast("int")


def failure_class(text: Column) -> Column:
    """The exception class that an error text names, or NULL."""
    return F.nullif(F.regexp_extract(text, CLASS_TEXT, 1), F.lit(""))


def stream_log(finalized: DataFrame, requests: DataFrame) -> DataFrame:
    """S2 rows of streamed requests (J8, A16): ``sse.finalize_streams`` with its requests
    (request_id, requested_model, and target_url if routed). A stream that failed is logged with its own status and
    error text; the time is that of the last line, or of the start if none came."""
    url = F.col("target_url") if "target_url" in requests.columns else F.lit("N/A")
    req = requests.select("request_id", F.col("requested_model").alias("model_id"), url.alias("backend_url"))
    j = finalized.join(req, "request_id")
    none = F.lit(None).cast("bigint")
    out = j.select(
        F.col("request_id").alias("id"), epoch_seconds(F.coalesce("last_ts", "started_at")).alias("timestamp"),
        "model_id", "backend_url",
        F.when(F.col("saw_error"), failure_status(F.col("error_code"), F.col("error_message"))).otherwise(
            F.lit(200)).cast("int").alias("status_code"),
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
        *[(F.col(c) if c in finalized.columns else none).alias(c) for c in USAGE_COLS],
        "error_message", "ttft_ms", "tokens_per_second")
    return out.select(*LOG_COLUMNS, epoch_date(F.col("timestamp")).alias("dt"))


def build_log(limited: DataFrame, responses: DataFrame, untracked: DataFrame | None = None,
              include_failed: bool = True) -> DataFrame:
    """J8 + S2 projection: one request-log row per request.

    ``limited`` is the output of ``routing.check_limit`` (with started_at and
    prompt_tokens). Invalid requests (F8/F9) produce no row. Routing failures
    (404/503) log the requested id, ``N/A`` and no usage; limit rejections log
    the backend root URL, status 400 and (estimate, 0, estimate); forwarded
    requests take the captured outcome (A17). ``include_failed=False`` keeps
    only successful requests (T16). Untracked models are dropped last (T15)."""
    req = limited.filter(~F.col("limit_status").isin(400, 422) | F.col("limit_exceeded"))
    resp = responses.select("request_id", "ended_at", "status_code", "failure_kind", "body")
    j = req.join(resp, "request_id", "left")
    fin = finalize_responses(j.withColumn("_est", F.col("prompt_tokens")), "_est")
    forwarded = (F.col("limit_status") == 200)
    est = F.col("_est").cast("bigint")
    start_epoch = epoch_seconds(F.col("started_at"))
    ts = F.when(forwarded, epoch_seconds(F.col("ended_at"))).otherwise(start_epoch)
    dur = F.when(forwarded, duration_ms(F.col("started_at"), F.col("ended_at"))).otherwise(F.lit(0.0))
    limit_hit = F.col("limit_exceeded")

    def usage_col(c: str) -> Column:
        on_limit = {"prompt_tokens": est, "completion_tokens": F.lit(0).cast("bigint"), "total_tokens": est}
        return (F.when(forwarded, F.col(c))
                 .when(limit_hit, on_limit.get(c, F.lit(None).cast("bigint")))
                 .otherwise(F.lit(None).cast("bigint"))).alias(c)

    out = fin.select(
        F.col("request_id").alias("id"),
        ts.alias("timestamp"),
        F.col("logged_model").alias("model_id"),
        F.when(forwarded, F.col("target_url")).when(limit_hit, F.col("backend_root_url"))
         .otherwise(F.lit("N/A")).alias("backend_url"),
        F.when(forwarded, F.col("final_status")).otherwise(F.col("limit_status")).cast("int").alias("status_code"),
        dur.alias("duration_ms"),
        *[usage_col(c) for c in USAGE_COLS],
        F.when(forwarded, F.col("error_message")).when(limit_hit, F.col("limit_message"))
         .when(F.col("limit_status") == 404, F.format_string(NOT_MAPPED_TEXT, F.col("requested_model")))
         .otherwise(F.format_string(NO_BACKENDS_TEXT, F.col("requested_model"))).alias("error_message"),
        F.when(forwarded, F.col("ttft_ms")).alias("ttft_ms"),
        F.when(forwarded, F.col("tokens_per_second")).alias("tokens_per_second"),
    )
    if not include_failed:
        # Failures are queued as background tasks right before an HTTP
        # error is raised, so they are likely never stored
        out = out.filter(F.col("status_code") == 200)
    if untracked is not None:
        ids = untracked.select("model_id").distinct()
        out = out.join(checked_broadcast(ids), "model_id", "left_anti")
    return out.select(*LOG_COLUMNS, epoch_date(F.col("timestamp")).alias("dt"))
