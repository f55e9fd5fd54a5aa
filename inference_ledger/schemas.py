"""Declared schemas of the fact and dimension tables (never inferred)."""

from pyspark.sql import types as T

# Request log: one row per proxied request. ``dt`` is the partition column of
# the stored table (UTC date of ``timestamp``); it is not part of the views.
LOG_COLUMNS = [
    "id", "timestamp", "model_id", "backend_url", "status_code", "duration_ms",
    "prompt_tokens", "completion_tokens", "total_tokens", "prompt_cached_tokens",
    "cache_creation_input_tokens", "cache_read_input_tokens", "error_message",
    "ttft_ms", "tokens_per_second",
]

LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.DoubleType(), False),
    T.StructField("model_id", T.StringType(), False),
    T.StructField("backend_url", T.StringType(), False),
    T.StructField("status_code", T.IntegerType(), False),
    T.StructField("duration_ms", T.DoubleType(), False),
    T.StructField("prompt_tokens", T.LongType(), True),
    T.StructField("completion_tokens", T.LongType(), True),
    T.StructField("total_tokens", T.LongType(), True),
    T.StructField("prompt_cached_tokens", T.LongType(), True),
    T.StructField("cache_creation_input_tokens", T.LongType(), True),
    T.StructField("cache_read_input_tokens", T.LongType(), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("ttft_ms", T.DoubleType(), True),
    T.StructField("tokens_per_second", T.DoubleType(), True),
])

LOG_WITH_DT = T.StructType(LOG.fields + [T.StructField("dt", T.DateType(), True)])

# Columns added to the request log after its first version; older files lack
# them and read back as NULL.
LOG_LATER_COLUMNS = [
    "prompt_cached_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
    "error_message", "ttft_ms", "tokens_per_second",
]
LOG_V1 = T.StructType([f for f in LOG.fields if f.name not in LOG_LATER_COLUMNS])

SYSTEM_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.DoubleType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("traceback", T.StringType(), True),
])

USAGE = T.StructType([
    T.StructField("prompt_tokens", T.LongType(), True),
    T.StructField("completion_tokens", T.LongType(), True),
    T.StructField("total_tokens", T.LongType(), True),
    T.StructField("prompt_tokens_details", T.MapType(T.StringType(), T.LongType()), True),
    T.StructField("completion_tokens_details", T.MapType(T.StringType(), T.LongType()), True),
    T.StructField("cache_creation_input_tokens", T.LongType(), True),
    T.StructField("cache_read_input_tokens", T.LongType(), True),
])

BACKENDS = T.StructType([
    T.StructField("pos", T.LongType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("context_size", T.IntegerType(), True),
])

MODEL_MAPPINGS = T.StructType([
    T.StructField("pos", T.LongType(), False),
    T.StructField("model_id", T.StringType(), False),
    T.StructField("backend_ids", T.ArrayType(T.StringType(), False), False),
])

UNTRACKED = T.StructType([T.StructField("model_id", T.StringType(), False)])

BACKEND_PROPS = T.StructType([
    T.StructField("props_url", T.StringType(), False),
    T.StructField("json", T.StringType(), True),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("started_at", T.TimestampNTZType(), False),
    T.StructField("body", T.StringType(), True),
])

RESPONSES = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("ended_at", T.TimestampNTZType(), False),
    T.StructField("status_code", T.IntegerType(), False),
    T.StructField("failure_kind", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
])

SSE_LINES = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("arrival_ts", T.TimestampNTZType(), False),
    T.StructField("line", T.StringType(), True),
])

# the native embedding paths are forwarded as they come, without an estimate or a limit check
NATIVE_PROTOCOLS = ("embed_native", "embeddings_native")
PROTOCOLS = ("chat", "responses", "messages", "embeddings", *NATIVE_PROTOCOLS)
