"""Registered routing/catalog queries: J1-J7, F7, A6-A10, S7, S8, P19-P22."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import PARSED, parsed_fields, prompt_estimate, reject_reason, reject_status, with_parsed
from ..operators import routing
from ..session import scratch_path
from ..sources import config, derive
from .registry import register

CFG = config.DEMO_CONFIG


def prepare_requests(req):
    """Validation (F8/F9) and the prompt estimate, parsing each body once."""
    req = with_parsed(req)
    v = F.col(PARSED)
    reason = reject_reason(F.col("protocol"), F.col("body"), v)
    model = F.coalesce(F.try_variant_get(v, "$.model", "string"), F.lit(""))
    req = req.select("request_id", "protocol", "started_at", model.alias("requested_model"), "stream",
                     reason.alias("reject_reason"),
                     reject_status(reason, F.col("protocol")).alias("reject_status"),
                     prompt_estimate(F.col("protocol"), F.col("body"), v, parsed_fields()).alias("prompt_tokens"))
    return req


def _routed(spark, sf_dir, pick="round_robin"):
    req = prepare_requests(derive.requests(spark, sf_dir))
    limits = routing.backend_limits(config.backends_df(spark, CFG))
    return routing.route(req, config.mappings_df(spark, CFG), limits,
                         CFG.get("default_model_id"), CFG.get("default_embedding_model_id"), pick)


ROUTE_COLS = ["request_id", "protocol", "requested_model", "resolved_model", "route_status",
              "n_backends", "backend_id", "target_url", "logged_model"]


@register("route_requests")
def route_requests(spark, sf_dir):
    return _routed(spark, sf_dir).select(*ROUTE_COLS)


@register("route_failures")
def route_failures(spark, sf_dir):
    r = _routed(spark, sf_dir).filter(~F.col("route_status").isin(200, 400, 422))
    return r.groupBy("route_status", "requested_model", "protocol").agg(F.count(F.lit(1)).alias("requests"))


@register("route_summary")
def route_summary(spark, sf_dir):
    r = _routed(spark, sf_dir)
    return r.groupBy("route_status", "resolved_model").agg(
        F.count(F.lit(1)).alias("requests"), F.max("backend_limit").alias("max_limit"))


@register("route_assign")
def route_assign(spark, sf_dir):
    r = _routed(spark, sf_dir, pick="hash").filter(F.col("route_status") == 200)
    return r.groupBy("resolved_model", "backend_id").agg(F.count(F.lit(1)).alias("requests"))


@register("limit_check")
def limit_check(spark, sf_dir):
    r = routing.check_limit(_routed(spark, sf_dir))
    return r.select("request_id", "protocol", "resolved_model", "backend_id", "prompt_tokens",
                    "backend_limit", "limit_exceeded", "limit_status", "limit_message", "limit_error")


def _catalog(spark, sf_dir):
    backends = derive.catalog_backends(spark, sf_dir)
    limits = routing.backend_limits(backends, derive.catalog_props(spark, sf_dir))
    # the catalogue shows first mappings only, so only their backends are collected
    kept = routing.first_positions(derive.catalog_heads(spark, sf_dir))
    return derive.catalog_mappings(spark, sf_dir, kept), backends, limits


@register("config_dims")
def config_dims(spark, sf_dir):
    m, b, _ = _catalog(spark, sf_dir)
    fm = routing.first_mappings(m)
    return fm.select("model_id", "map_pos", F.size("backend_ids").alias("n_backend_ids"))


@register("limits_from_props")
def limits_from_props(spark, sf_dir):
    _, b, limits = _catalog(spark, sf_dir)
    return limits.select("pos", "id", "url", routing.props_url(F.col("url")).alias("props_url"), "context_limit")


@register("model_list")
def model_list(spark, sf_dir):
    m, _, limits = _catalog(spark, sf_dir)
    return routing.model_list(m, limits)


@register("model_browser")
def model_browser(spark, sf_dir):
    m, b, limits = _catalog(spark, sf_dir)
    browser = routing.model_browser(m, b, limits, derive.CATALOG_DEFAULT_MODEL,
                                    derive.CATALOG_DEFAULT_EMBEDDING_MODEL)
    return routing.flatten_browser(browser)


@register("config_file")
def config_file(spark, sf_dir):
    """A catalogue written as a folder of JSON lines, some of them faulty, and read with the rules of
    a configuration: records and rejected lines per reason."""
    folder = scratch_path(spark, "catalogue")
    derive.catalog_lines(spark, sf_dir).write.text(folder)
    backends, mappings, rejected = config.read_records(spark, folder)
    return (backends.selectExpr("'backend' AS kind", "CAST(NULL AS STRING) AS reason", "context_size AS n")
            .unionByName(mappings.selectExpr("'mapping' AS kind", "CAST(NULL AS STRING) AS reason", "size(backend_ids) AS n"))
            .unionByName(rejected.selectExpr("'rejected' AS kind", "reason", "CAST(NULL AS INT) AS n"))
            .groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("n")))
