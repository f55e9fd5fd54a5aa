"""Registered prompt / token / validation queries: P13-P18, P26-P27, F8-F9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jsontext import last_wins
from ..functions.prompts import (PARSED, parsed_fields, prompt_estimate, prompt_text, reject_reason, reject_status,
                                 with_parsed, with_payload)
from ..functions.tokens import estimate_tokens, flatten_content
from ..session import spread
from ..sources import derive
from ..sources.tables import read_table
from .registry import register


def _prompt(protocols):
    def q(spark, sf_dir):
        req = with_parsed(derive.requests(spark, sf_dir))
        v = F.col(PARSED)
        req = req.filter(F.col("protocol").isin(*protocols))
        return req.select(
            "request_id", "protocol",
            reject_reason(F.col("protocol"), F.col("body"), v).alias("reject_reason"),
            prompt_text(F.col("protocol"), F.col("body"), v, parsed_fields()).alias("prompt_text"),
            prompt_estimate(F.col("protocol"), F.col("body"), v, parsed_fields()).alias("prompt_tokens"))
    return q


register("prompt_text_chat")(_prompt(["chat"]))
register("prompt_text_responses")(_prompt(["responses"]))
register("prompt_text_messages")(_prompt(["messages"]))
register("prompt_text_embeddings")(_prompt(["embeddings", "embed_native", "embeddings_native"]))


@register("token_estimate")
def token_estimate(spark, sf_dir):
    """P14 (native) over whole texts of two tables, summed per group."""
    conv = spread(read_table(spark, sf_dir, "conversations", "role", "text")).select(
        F.lit("conversations").alias("source"), F.col("role").alias("grp"), "text")
    docs = spread(read_table(spark, sf_dir, "documents", "lang", "text")).select(
        F.lit("documents").alias("source"), F.col("lang").alias("grp"), "text")
    return conv.unionByName(docs).groupBy("source", "grp").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(estimate_tokens(F.col("text"))).alias("token_estimate"))


@register("request_validate")
def request_validate(spark, sf_dir):
    req = with_parsed(derive.requests(spark, sf_dir))
    reason = reject_reason(F.col("protocol"), F.col("body"), F.col(PARSED))
    return req.select("request_id", "protocol", reason.alias("reject_reason"),
                      reject_status(reason, F.col("protocol")).alias("reject_status"))


@register("payload_normalise")
def payload_normalise(spark, sf_dir):
    """P26 + P27: the whole payload that is forwarded, for chat, responses and messages."""
    req = last_wins(derive.requests(spark, sf_dir).filter(F.col("protocol").isin("chat", "responses", "messages")), "body", "_v", "_t")
    streamed = F.coalesce(F.try_variant_get("_v", "$.stream", "boolean"), F.lit(False))
    req = req.withColumn("_force", F.col("protocol").isin("chat", "responses") & streamed)
    out = with_payload(req, "body", "protocol = 'chat'", "_force")
    return out.filter("payload IS NOT NULL").select("request_id", "protocol", "payload")


@register("content_flatten")
def content_flatten(spark, sf_dir):
    """P13 over chat message contents: odd turns carry list content with a text
    part and an image part, even turns a plain string."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    as_str = derive._json_str(F.col("text"))
    content = F.when(F.col("turn") % 2 == 0, as_str).otherwise(F.concat(
        F.lit('[{"type":"text","text":'), as_str, F.lit('},{"type":"image_url","image_url":{"url":"u"}}]')))
    staged = conv.select("conv_id", "turn", flatten_content(content).alias("flat"))
    return staged.select("conv_id", "turn", F.length("flat").alias("chars"),
                         estimate_tokens(F.col("flat")).alias("tokens"))
