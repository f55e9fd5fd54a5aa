"""Registered usage / error / log-build queries: P8-P12, P23-P24, A17, J8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import finalize, routing
from ..sources import config, derive
from .q_routing import CFG, _routed
from .registry import register

USAGE_OUT = ["request_id", "protocol", "final_status", "prompt_tokens", "completion_tokens", "total_tokens",
             "prompt_cached_tokens", "cache_creation_input_tokens", "cache_read_input_tokens",
             "ttft_ms", "tokens_per_second", "error_message"]


def _finalized(spark, sf_dir):
    req = _routed(spark, sf_dir).select("request_id", "protocol", "prompt_tokens")
    resp = derive.responses(spark, sf_dir)
    return finalize.finalize_responses(req.join(resp, "request_id", "inner"))


def _usage(protocols):
    def q(spark, sf_dir):
        return _finalized(spark, sf_dir).filter(F.col("protocol").isin(*protocols)).select(*USAGE_OUT)
    return q


register("usage_chat")(_usage(["chat"]))
register("usage_responses")(_usage(["responses"]))
register("usage_messages")(_usage(["messages"]))
register("usage_embed")(_usage(["embeddings", "embed_native", "embeddings_native"]))


@register("error_normalise")
def error_normalise(spark, sf_dir):
    resp = derive.responses(spark, sf_dir).filter(F.col("failure_kind") == "http")
    req = derive.requests(spark, sf_dir).select("request_id", "protocol")
    j = resp.join(req, "request_id", "inner")
    payload, detail = finalize.backend_error_payload(F.col("body"), F.col("status_code"),
                                                     F.col("protocol") != "messages")
    return j.select("request_id", "protocol", "status_code", payload.alias("error_payload"),
                    detail.alias("error_detail"))


def plain_log(spark, sf_dir):
    limited = routing.check_limit(_routed(spark, sf_dir))
    return finalize.build_log(limited, derive.responses(spark, sf_dir), config.untracked_df(spark, CFG))


@register("log_build")
def log_build(spark, sf_dir):
    return derive.log_columns(plain_log(spark, sf_dir))


@register("log_build_bucketed")
def log_build_bucketed(spark, sf_dir):
    """J8 with co-located capture tables: requests and responses are written
    bucketed by request_id (as a capture job would land them), so the
    request-response join reads matching buckets and shuffles neither side."""
    from ..session import scratch_path
    from ..sources import logstore
    from .q_routing import prepare_requests
    n = spark.sparkContext.defaultParallelism          # one bucket per core of the cluster
    rq = logstore.write_bucketed(derive.requests(spark, sf_dir), scratch_path(spark, "cap-req"), "request_id", n)
    rs = logstore.write_bucketed(derive.responses(spark, sf_dir), scratch_path(spark, "cap-resp"), "request_id", n)
    limits = routing.backend_limits(config.backends_df(spark, CFG))
    routed = routing.route(prepare_requests(spark.table(rq)), config.mappings_df(spark, CFG), limits,
                           CFG.get("default_model_id"), CFG.get("default_embedding_model_id"))
    log = finalize.build_log(routing.check_limit(routed), spark.table(rs), config.untracked_df(spark, CFG))
    return derive.log_columns(log)
