"""Registered SSE-fold queries: F5, F6, A11-A16, P7, P25."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import with_estimate
from ..operators import finalize, sse, stats
from ..session import scratch_path
from ..sources import derive, logstore
from . import params as P
from .q_usage import plain_log
from .registry import register

# lines of a part of a text: small, so that the fixture's texts have several
PART_LINES = 64
SSE_OUT = ["request_id", "part", "text", "prompt_tokens", "completion_tokens", "total_tokens",
           "cache_read_input_tokens", "ttft_ms", "duration_ms", "tokens_per_second", "error_message"]


def stream_results(spark, sf_dir, protocol):
    req = with_estimate(derive.stream_requests(spark, sf_dir).filter(F.col("protocol") == protocol))
    lines = derive.sse_lines(spark, sf_dir).filter(F.col("protocol") == protocol)
    parts = sse.fold_partials(sse.parse_lines(lines), PART_LINES)
    return sse.with_text(sse.finalize_streams(sse.stitch(parts), req), sse.text_parts(parts))


def _sse(protocol):
    def q(spark, sf_dir):
        return stream_results(spark, sf_dir, protocol).select(*SSE_OUT)
    return q


register("sse_chat")(_sse("chat"))
register("sse_responses")(_sse("responses"))
register("sse_messages")(_sse("messages"))


@register("sse_errors")
def sse_errors(spark, sf_dir):
    """P25: per request, whether the stream carried an error event and ended cleanly."""
    f = sse.fold(derive.sse_lines(spark, sf_dir))
    return f.groupBy("protocol", "saw_done", "saw_error").agg(F.count(F.lit(1)).alias("requests"))


@register("log_build_streams")
def log_build_streams(spark, sf_dir):
    """Captured stream lines -> folds -> request-log rows -> per-model stats."""
    req = derive.stream_requests(spark, sf_dir)
    final = sse.finalize_streams(sse.fold(derive.sse_lines(spark, sf_dir)), with_estimate(req))
    return stats.round_averages(stats.model_rollup(finalize.stream_log(final, req)), P.ROUND_DIGITS)


@register("log_build_all")
def log_build_all(spark, sf_dir):
    """One log of plain calls and streams (J8, S2): both append rows without ids, the log numbers them."""
    req = derive.stream_requests(spark, sf_dir)
    streams = finalize.stream_log(sse.finalize_streams(sse.fold(derive.sse_lines(spark, sf_dir)), with_estimate(req)), req)
    root = scratch_path(spark, "log-all")
    for rows in (plain_log(spark, sf_dir), streams):
        logstore.append_log(rows.drop("id"), root)
    return logstore.read_log(spark, root).groupBy("model_id", "status_code").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("total_tokens").alias("total_tokens"), F.count("error_message").alias("errors"))
