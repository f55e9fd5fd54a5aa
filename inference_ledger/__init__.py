"""Spark-native analytics over LLM proxy traffic.

Captured requests, responses and server-sent-event lines are validated, routed
against model/backend dimensions, folded into one request-log row each, and
summarised (totals, per-model rollups, time series, paged views) with plain
DataFrame operations, in batch and in Structured Streaming.
"""

__all__ = ["session", "schemas"]
