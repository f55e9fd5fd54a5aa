"""Registered view queries: L2-L9, A18, F4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, views
from ..sources import config, derive
from . import params as P
from .registry import register


def _log(spark, sf_dir):
    return derive.request_log(spark, sf_dir)


@register("recent_logs_page")
def recent_logs_page(spark, sf_dir):
    return derive.log_columns(views.recent_logs(_log(spark, sf_dir), P.RECENT_LIMIT, P.RECENT_OFFSET))


@register("recent_logs_page3")
def recent_logs_page3(spark, sf_dir):
    return derive.log_columns(views.recent_logs(_log(spark, sf_dir), P.RECENT_LIMIT, 2 * P.RECENT_LIMIT))


@register("recent_logs_keyset")
def recent_logs_keyset(spark, sf_dir):
    # keyset page: the 50 newest rows older than the as-of instant
    before = P.AS_OF_EPOCH - 24 * 3600
    return derive.log_columns(views.logs_before(derive.request_log(spark, sf_dir, until=before), before, 2 ** 62, P.RECENT_LIMIT))


@register("all_logs")
def all_logs(spark, sf_dir):
    return derive.log_columns(views.all_logs(_log(spark, sf_dir)))


@register("system_logs_topk")
def system_logs_topk(spark, sf_dir):
    return views.system_logs_top(derive.system_log(spark, sf_dir), P.SYSTEM_LOG_LIMIT)


@register("log_view")
def log_view(spark, sf_dir):
    return views.log_view(_log(spark, sf_dir), P.LOG_PAGE_LIMIT, 0)


@register("log_view_page2")
def log_view_page2(spark, sf_dir):
    return views.log_view(_log(spark, sf_dir), P.LOG_PAGE_LIMIT, P.LOG_PAGE_LIMIT)


@register("system_log_view")
def system_log_view(spark, sf_dir):
    return views.system_log_view(derive.system_log(spark, sf_dir), P.SYSTEM_LOG_PAGE_LIMIT)


@register("stats_view")
def stats_view(spark, sf_dir):
    return stats.round_averages(views.stats_view(_log(spark, sf_dir), "all"), P.ROUND_DIGITS)


@register("stats_view_day")
def stats_view_day(spark, sf_dir):
    return stats.round_averages(views.stats_view(_log(spark, sf_dir), "day", P.AS_OF_EPOCH), P.ROUND_DIGITS)


@register("model_cards")
def model_cards(spark, sf_dir):
    return stats.round_averages(views.model_cards(_log(spark, sf_dir)), P.ROUND_DIGITS)


@register("untracked_filtered")
def untracked_filtered(spark, sf_dir):
    untracked = config.untracked_df(spark, config.DEMO_CONFIG)
    return derive.log_columns(views.drop_untracked(_log(spark, sf_dir), untracked))
