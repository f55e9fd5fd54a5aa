"""SSE stream fold: F5, F6, A11-A16, P7, P25 (+ T6, T7, T19, T22).

``fold`` turns captured lines ``(request_id, protocol, seq, arrival_ts, line)``
into one row per request with the token count of its text, the last usage (chat /
responses: the whole last valid object; messages: per-field cumulative), the
first-token time, the stream end and error flags -- all with native
aggregates, no Python.

Skew: a request's lines are first aggregated per ``(request_id, seq bucket)``
(at most ``bucket_rows`` lines per group), then the bucket partials are
stitched per request. Order-insensitive pieces (min/max over structs keyed by
``seq``) are algebraic and pre-aggregate map-side; the only ordered piece, the
text, stays in its buckets: it is returned as rows (request, part, text), and counted by segments that merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import usage as U
from ..functions.timefmt import duration_ms
from ..functions.tokens import merged_segments, segment_tokens, text_segment

BUCKET_ROWS = 4096
DATA_PREFIX = "data: "
DONE = "[DONE]"
# fixed values: the dialects' own last events
END_EVENTS = ("response.completed", "response.failed", "response.incomplete", "message_stop")


def _trimmed(line: Column) -> Column:
    """Text after ``data: `` with surrounding whitespace removed (T22); NULL
    for non-data lines."""
    return F.when(line.startswith(DATA_PREFIX),
                  F.regexp_replace(F.substring(line, len(DATA_PREFIX) + 1, 1 << 30), r"^\s+|\s+$", ""))


def payload(line: Column) -> Column:
    """the trimmed payload; NULL for non-data lines, empty payloads and ``[DONE]``."""
    t = _trimmed(line)
    return F.when((t != "") & (t != DONE), t)


def _nonempty_array(x: Column) -> Column:
    return F.coalesce(F.array_size(F.try_variant_get(x, "$", "array<variant>")) > 0, F.lit(False))


def _nonempty_object(x: Column) -> Column:
    return F.coalesce(F.size(F.try_variant_get(x, "$", "map<string,variant>")) > 0, F.lit(False))


def _string_at(v: Column, path: str) -> Column:
    """The string at ``path`` if it is a JSON string, else NULL."""
    x = U.vget(v, path)
    return F.when(U.vkind(x) == "STRING", F.try_variant_get(x, "$", "string"))


def _chat(v: Column) -> tuple[Column, Column]:
    # any non-empty `choices` is a first token; text = truthy choices[0].delta.content
    first = _nonempty_array(U.vget(v, "$.choices"))
    text = F.when(first, F.coalesce(_string_at(v, "$.choices[0].delta.content"), F.lit("")))
    return first, text


def _responses(v: Column) -> tuple[Column, Column]:
    # non-empty `output` (text items / message contents) and typed text deltas
    has_output = _nonempty_array(U.vget(v, "$.output"))
    items = F.try_variant_get(v, "$.output", "array<variant>")
    item_text = F.transform(items, lambda it: F.when(
        (F.try_variant_get(it, "$.type", "string") == "text") & U.has(it, "$.text"),
        F.coalesce(F.try_variant_get(it, "$.text", "string"), F.lit("")))
        .when((F.try_variant_get(it, "$.type", "string") == "message")
              & F.try_variant_get(it, "$.message", "map<string,variant>").isNotNull(),
              F.coalesce(_string_at(it, "$.message.content"), F.lit("")))
        .otherwise(F.lit("")))
    delta = F.when(F.try_variant_get(v, "$.type", "string") == "response.output_text.delta",
                   F.coalesce(_string_at(v, "$.delta"), F.lit("")))
    typed = F.coalesce(delta != "", F.lit(False))
    first = has_output | typed
    joined = F.coalesce(F.array_join(item_text, ""), F.lit(""))
    text = F.concat(F.when(has_output, joined).otherwise(F.lit("")), F.when(typed, delta).otherwise(F.lit("")))
    return first, text


def _messages(v: Column) -> tuple[Column, Column]:
    # content_block_delta carrying a `text` key
    first = F.coalesce((F.try_variant_get(v, "$.type", "string") == "content_block_delta")
                       & U.has(v, "$.delta.text"), F.lit(False))
    text = F.when(first, F.coalesce(_string_at(v, "$.delta.text"), F.lit("")))
    return first, text


def _usage_object(v: Column, protocol: Column) -> Column:
    """Top-level ``usage`` if truthy, else the dialect's nested one."""
    top = U.vget(v, "$.usage")
    nested = F.when(protocol == "responses", U.vget(v, "$.response.usage")) \
        .when(protocol == "messages", U.vget(v, "$.message.usage"))
    return F.when(_nonempty_object(top), top).when(_nonempty_object(nested), nested)


def parse_lines(lines: DataFrame) -> DataFrame:
    """F5 + F6 + P25: one row per line with the chunk's contributions.
    Non-object or malformed JSON contributes nothing (the stream goes on).

    Staged projections keep the per-line cost low: the payload is trimmed
    once, only the line's own dialect branch is evaluated, and usage fields
    are read only on lines that carry a usage object."""
    t = lines.select("request_id", "protocol", "seq", "arrival_ts", "line", _trimmed(F.col("line")).alias("_t"))
    t = t.select("request_id", "protocol", "seq", "arrival_ts", "line",
                 F.coalesce(F.col("_t") == DONE, F.lit(False)).alias("_done"),
                 F.when((F.col("_t") != "") & (F.col("_t") != DONE), F.col("_t")).alias("_payload"))
    parsed = t.select("request_id", "protocol", "seq", "arrival_ts", "line", "_done",
                      F.try_parse_json(F.col("_payload")).alias("_v"))
    v = F.col("_v")
    proto = F.col("protocol")
    is_obj = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    cf, ct = _chat(v)
    rf, rt = _responses(v)
    mf, mt = _messages(v)
    first = F.when(proto == "chat", cf).when(proto == "responses", rf).otherwise(mf)
    text = F.when(proto == "chat", ct).when(proto == "responses", rt).otherwise(mt)
    staged = parsed.select(
        "request_id", "protocol", "seq", "arrival_ts", "_done",
        is_obj.alias("_ok"),
        F.when(is_obj, F.coalesce(first, F.lit(False))).otherwise(F.lit(False)).alias("first_token"),
        F.when(is_obj, F.coalesce(text, F.lit(""))).otherwise(F.lit("")).alias("piece"),
        F.when(is_obj, _usage_object(v, proto)).alias("_u"),
        ((F.col("line") == "event: error") | (is_obj & U.has(v, "$.error"))).alias("_error"),
        F.when(is_obj, F.try_variant_get(v, "$.error.message", "string")).alias("_err_msg"),
        F.when(is_obj, U.as_int(v, "$.error.code")).alias("_err_code"),
        F.when(is_obj, F.try_variant_get(v, "$.type", "string").isin(*END_EVENTS)).alias("_last"),
    )
    # chat/responses: usage_from_dict with a deferred fallback prompt; only on usage lines
    uu = F.col("_u")
    p_has, i_has = U.has(uu, "$.prompt_tokens"), U.has(uu, "$.input_tokens")
    c_has, o_has = U.has(uu, "$.completion_tokens"), U.has(uu, "$.output_tokens")
    prompt = F.when(p_has, U.whole(uu, "$.prompt_tokens")).when(i_has, U.whole(uu, "$.input_tokens"))
    completion = F.when(c_has, U.whole(uu, "$.completion_tokens")).when(o_has, U.whole(uu, "$.output_tokens")) \
        .otherwise(F.lit(0).cast("bigint"))
    total = U.whole(uu, "$.total_tokens")
    valid = ((~(p_has | i_has) | prompt.isNotNull()) & completion.isNotNull()
             & (~U.has(uu, "$.total_tokens") | total.isNotNull()) & U.extras_valid(uu))
    on = uu.isNotNull()

    def u(col: Column) -> Column:
        return F.when(on, col)

    return staged.select(
        "request_id", "protocol", "seq", "arrival_ts", "_done", "_error", "_err_msg", "_err_code", "first_token", "piece",
        (F.col("_done") | F.coalesce("_error", F.lit(False)) | F.coalesce("_last", F.lit(False))).alias("_end"),
        F.coalesce(u(valid), F.lit(False)).alias("has_usage"),
        u(prompt).alias("u_prompt"), u(completion).alias("u_completion"), u(total).alias("u_total"),
        u(U.as_int(uu, "$.prompt_tokens_details.cached_tokens")).alias("u_cached"),
        u(U.as_int(uu, "$.cache_creation_input_tokens")).alias("u_creation"),
        u(U.as_int(uu, "$.cache_read_input_tokens")).alias("u_read"),
        F.coalesce(u(i_has), F.lit(False)).alias("m_in_has"),
        u(U.as_int(uu, "$.input_tokens")).alias("m_in"),
        F.coalesce(u(o_has), F.lit(False)).alias("m_out_has"),
        u(U.as_int(uu, "$.output_tokens")).alias("m_out"),
    )


def _last(present: Column, value: Column) -> Column:
    """Value at the greatest ``seq`` among rows where ``present`` holds, as a
    (seq, value) struct so it can be combined again after bucketing."""
    return F.max(F.when(present, F.struct(F.col("seq").alias("s"), value.alias("v"))))


PARTIAL_KEYS = ["request_id", "protocol", "bucket"]


def fold_partials(parsed: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Phase 1: aggregates per (request_id, protocol, seq bucket). Works on a
    batch or a streaming DataFrame (then every bucket's state holds at most
    ``bucket_rows`` lines)."""
    p = parsed
    usage_struct = F.struct("u_prompt", "u_completion", "u_total", "u_cached", "u_creation", "u_read")
    return p.groupBy("request_id", "protocol", F.floor(F.col("seq") / bucket_rows).alias("bucket")).agg(
        F.collect_set(F.when(F.col("piece") != "", F.struct("seq", "piece"))).alias("pieces"),
        F.min(F.when(F.col("first_token"), F.col("arrival_ts"))).alias("first_token_ts"),
        F.max("arrival_ts").alias("last_ts"),
        F.max(F.col("_done").cast("int")).alias("saw_done"),
        F.max(F.col("_end").cast("int")).alias("saw_end"),
        F.max(F.col("_error").cast("int")).alias("saw_error"),
        _last(F.col("_err_msg").isNotNull(), F.col("_err_msg")).alias("err"),
        _last(F.col("_err_code").isNotNull(), F.col("_err_code")).alias("err_code"),
        _last(F.col("has_usage"), usage_struct).alias("last_usage"),
        F.max(F.when(F.col("has_usage"), F.col("seq"))).alias("any_usage"),
        _last(F.col("m_in_has"), F.col("m_in")).alias("m_in"),
        _last(F.col("m_out_has"), F.col("m_out")).alias("m_out"),
        _last(F.col("u_creation").isNotNull(), F.col("u_creation")).alias("m_creation"),
        _last(F.col("u_read").isNotNull(), F.col("u_read")).alias("m_read"),
    )


def merge_partials(parts: DataFrame) -> DataFrame:
    """Parts of the same bucket from several batches as one: everything in a part is a
    minimum, a maximum by ``seq`` or a set keyed by ``seq``, so repeats change nothing."""
    least = [F.min(c).alias(c) for c in ("first_token_ts",)]
    most = [F.max(c).alias(c) for c in ("last_ts", "saw_done", "saw_end", "saw_error", "err", "err_code", "last_usage",
                                        "any_usage", "m_in", "m_out", "m_creation", "m_read")]
    return parts.groupBy(*PARTIAL_KEYS).agg(
        F.array_distinct(F.flatten(F.collect_list("pieces"))).alias("pieces"), *least, *most)


def text_parts(part: DataFrame) -> DataFrame:
    """(request_id, protocol, part, text), the text of every seq bucket that has one. A request's text
    is these rows in order of ``part``; it is never one value."""
    text = F.array_join(F.transform(F.array_sort("pieces"), lambda x: x.getField("piece")), "")
    return part.filter(F.size("pieces") > 0).select("request_id", "protocol", F.col("bucket").alias("part"), text.alias("text"))


GROUP = 4096        # buckets whose segments are merged at once


def text_tokens(part: DataFrame) -> DataFrame:
    """(request_id, protocol, text_tokens): the estimate over a request's whole text, from segments of its parts.
    A token that two parts share counts once. Segments are merged in groups of buckets, then per request, so
    that no row holds more than ``GROUP`` of them for every 2^24 lines."""
    parts = text_parts(part).select("request_id", "protocol", "part", text_segment(F.col("text")).alias("segment"))

    def merged(df: DataFrame, order: str, *keys: str) -> DataFrame:
        listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "segment"))).alias("_s"))
        return listed.select(*keys, merged_segments(F.transform("_s", lambda x: x["segment"])).alias("segment"))

    groups = merged(parts.withColumn("group", F.expr(f"part div {GROUP}")), "part", "request_id", "protocol", "group")
    whole = merged(groups, "group", "request_id", "protocol")
    return whole.select("request_id", "protocol", segment_tokens(F.col("segment")).alias("text_tokens"))


def stitch(part: DataFrame) -> DataFrame:
    """Phase 2: combine the bucket partials of each request: the text as a count, the rest as max/min
    over (seq, value) structs."""
    whole = part.groupBy("request_id", "protocol").agg(
        F.min("first_token_ts").alias("first_token_ts"),
        F.max("last_ts").alias("last_ts"),
        (F.max("saw_done") == 1).alias("saw_done"),
        (F.max("saw_end") == 1).alias("saw_end"),
        (F.max("saw_error") == 1).alias("saw_error"),
        F.max("err").alias("err"), F.max("err_code").alias("err_code"),
        F.max("last_usage").alias("last_usage"),
        F.max("any_usage").isNotNull().alias("usage_seen"),
        F.max("m_in").alias("m_in"), F.max("m_out").alias("m_out"),
        F.max("m_creation").alias("m_creation"), F.max("m_read").alias("m_read"),
    ).join(text_tokens(part), ["request_id", "protocol"], "left")
    msgs = F.col("protocol") == "messages"
    lu = F.col("last_usage.v")
    return whole.select(
        "request_id", "protocol", F.coalesce("text_tokens", F.lit(0)).cast("bigint").alias("text_tokens"), "usage_seen", "first_token_ts", "last_ts", "saw_done", "saw_end", "saw_error",
        F.col("err.v").alias("error_message"), F.col("err_code.v").alias("error_code"),
        F.when(msgs, F.col("m_in.v")).otherwise(lu.getField("u_prompt")).alias("u_prompt"),
        F.when(msgs, F.coalesce(F.col("m_out.v"), F.lit(0).cast("bigint"))).otherwise(lu.getField("u_completion")).alias("u_completion"),
        F.when(msgs, F.lit(None).cast("bigint")).otherwise(lu.getField("u_total")).alias("u_total"),
        F.when(msgs, F.lit(None).cast("bigint")).otherwise(lu.getField("u_cached")).alias("u_cached"),
        F.when(msgs, F.col("m_creation.v")).otherwise(lu.getField("u_creation")).alias("u_creation"),
        F.when(msgs, F.col("m_read.v")).otherwise(lu.getField("u_read")).alias("u_read"),
    )


def fold(lines: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A11-A15 per request. Output: request_id, protocol, text_tokens, usage_seen,
    u_prompt/u_completion/u_total/u_cached/u_creation/u_read (chat/responses:
    fields of the last valid usage object; messages: cumulative per field),
    first_token_ts, last_ts, saw_done, saw_end, saw_error."""
    return stitch(fold_partials(parse_lines(lines), bucket_rows))


def with_text(results: DataFrame, parts: DataFrame) -> DataFrame:
    """Results of requests beside their text: a row per request and part, part 0 with an empty text where there is none."""
    return (results.join(parts.select("request_id", "part", "text"), "request_id", "left")
            .withColumn("part", F.coalesce("part", F.lit(0)).cast("bigint")).withColumn("text", F.coalesce("text", F.lit(""))))


def finalize_streams(folded: DataFrame, stream_requests: DataFrame, estimate: str = "prompt_tokens") -> DataFrame:
    """A16 + P7 + J8 for streams: join every request (start time and prompt estimate) to its
    fold; a request without a captured line keeps the estimate. With usage: prompt falls back to
    the estimate, total to prompt + completion. Without usage: (estimate, count(text), sum)
    however the stream ended, with ``[DONE]`` or not; a failed stream counts no text (T19)."""
    req = stream_requests.select("request_id", F.col("protocol").alias("_protocol"), "started_at",
                                 F.col(estimate).alias("_est")) if "protocol" in stream_requests.columns else \
        stream_requests.select("request_id", F.lit(None).cast("string").alias("_protocol"), "started_at",
                               F.col(estimate).alias("_est"))
    j = (req.join(folded, "request_id", "left")
         .withColumn("protocol", F.coalesce("protocol", "_protocol")).drop("_protocol")
         .withColumn("text_tokens", F.coalesce("text_tokens", F.lit(0)))
         .withColumn("usage_seen", F.coalesce("usage_seen", F.lit(False)))
         .withColumn("saw_error", F.coalesce("saw_error", F.lit(False))))
    est = F.col("_est").cast("bigint")
    clean = ~F.col("saw_error")
    counted = F.when(clean, F.col("text_tokens").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    seen = F.col("usage_seen")
    prompt = F.when(seen, F.coalesce(F.col("u_prompt"), est)).otherwise(est)
    completion = F.when(seen, F.col("u_completion")).otherwise(counted)
    staged = j.select(
        "request_id", "protocol", "started_at", "first_token_ts", "last_ts", "saw_error", "error_message", "error_code",
        prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
        F.when(seen, F.coalesce(F.col("u_total"), prompt + F.col("u_completion"))).otherwise(est + counted)
         .alias("total_tokens"),
        F.col("u_cached").alias("prompt_cached_tokens"),
        F.col("u_creation").alias("cache_creation_input_tokens"),
        F.col("u_read").alias("cache_read_input_tokens"),
    )
    ttft = duration_ms(F.col("started_at"), F.col("first_token_ts"))
    dur = duration_ms(F.col("started_at"), F.col("last_ts"))
    staged = staged.select("*", ttft.alias("ttft_ms"), dur.alias("duration_ms"))
    t, d, c = F.col("ttft_ms"), F.col("duration_ms"), F.col("completion_tokens")
    tps = F.when(t.isNotNull() & (d > t) & (c > 0), c / ((d - t) / F.lit(1000.0)))
    return staged.select("*", tps.alias("tokens_per_second"))
