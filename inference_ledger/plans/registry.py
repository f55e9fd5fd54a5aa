"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the given tables (or capture tables Spark derives from
them), over whole tables. Keys follow the operator ids of the blueprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import stats
from ..sources import derive
from . import params as P

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = fn
        return fn
    return deco


def all_queries() -> dict[str, Query]:
    # import the modules that register more queries
    from . import q_views, q_routing, q_usage, q_sse, q_prompts, q_sources, q_streaming  # noqa: F401
    return dict(_REGISTRY)


# ---------------------------------------------------------------- stats (A1-A5)

def _log(spark, sf_dir, hours=None):
    """The log; with ``hours``, of the events since then (the measures still apply their own bound)."""
    return derive.request_log(spark, sf_dir, P.AS_OF_EPOCH - hours * 3600 if hours else None)


@register("totals_all")
def totals_all(spark, sf_dir):
    return stats.round_averages(stats.totals(_log(spark, sf_dir)), P.ROUND_DIGITS)


@register("totals_hour")
def totals_hour(spark, sf_dir):
    hours = stats.period_hours("hour")
    return stats.round_averages(stats.totals(_log(spark, sf_dir, hours), hours, P.AS_OF_EPOCH), P.ROUND_DIGITS)


@register("totals_day")
def totals_day(spark, sf_dir):
    hours = stats.period_hours("day")
    return stats.round_averages(stats.totals(_log(spark, sf_dir, hours), hours, P.AS_OF_EPOCH), P.ROUND_DIGITS)


@register("totals_month")
def totals_month(spark, sf_dir):
    hours = stats.period_hours("month")
    return stats.round_averages(stats.totals(_log(spark, sf_dir, hours), hours, P.AS_OF_EPOCH), P.ROUND_DIGITS)


@register("totals_empty")
def totals_empty(spark, sf_dir):
    # a window after the end of the data: every row is filtered out -> A2 zero-fill
    later = P.AS_OF_EPOCH + 365 * 24 * 3600
    return stats.round_averages(stats.totals(_log(spark, sf_dir), 1, later), P.ROUND_DIGITS)


@register("model_rollup")
def model_rollup(spark, sf_dir):
    return stats.round_averages(stats.model_rollup(_log(spark, sf_dir)), P.ROUND_DIGITS)


@register("model_rollup_day")
def model_rollup_day(spark, sf_dir):
    hours = stats.period_hours("day")
    return stats.round_averages(stats.model_rollup(_log(spark, sf_dir, hours), hours, P.AS_OF_EPOCH),
                                P.ROUND_DIGITS)


@register("totals_and_models")
def totals_and_models(spark, sf_dir):
    return stats.round_averages(stats.totals_and_models(_log(spark, sf_dir)), P.ROUND_DIGITS)


@register("series_hour")
def series_hour(spark, sf_dir):
    return stats.time_series(_log(spark, sf_dir, stats.SERIES_PERIODS["hour"][1] // 3600), "hour", P.AS_OF_EPOCH)


@register("series_day")
def series_day(spark, sf_dir):
    return stats.time_series(_log(spark, sf_dir, stats.SERIES_PERIODS["day"][1] // 3600), "day", P.AS_OF_EPOCH)


@register("series_month")
def series_month(spark, sf_dir):
    return stats.time_series(_log(spark, sf_dir, stats.SERIES_PERIODS["month"][1] // 3600), "month", P.AS_OF_EPOCH)


@register("series_unknown")
def series_unknown(spark, sf_dir):
    return stats.time_series(_log(spark, sf_dir), "week", P.AS_OF_EPOCH)
