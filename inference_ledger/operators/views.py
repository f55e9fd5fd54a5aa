"""Paged and rendered views of the logs: L2-L9, A18, F4.

Pages use ``orderBy(...).offset(o).limit(k)``, which Spark plans as a
``TakeOrderedAndProject``: each partition keeps its top ``o + k`` rows and only
those reach the final merge. ``logs_before`` is the keyset alternative for deep
paging (a pushed-down range predicate instead of a growing offset).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display as D
from ..functions.timefmt import human_time
from ..functions.timefmt import epoch_date
from ..session import checked_broadcast
from . import stats

def _newest_first():
    return [F.desc("timestamp"), F.desc("id")]


def _clamp(limit: int | None, offset: int | None) -> tuple[int | None, int]:
    """A negative limit means no limit; a negative offset means 0."""
    lim = None if limit is None or limit < 0 else int(limit)
    off = max(0, int(offset or 0))
    return lim, off


def recent_logs(log: DataFrame, limit: int | None = 50, offset: int | None = 0) -> DataFrame:
    """L2: newest first with limit/offset."""
    lim, off = _clamp(limit, offset)
    df = log.orderBy(*_newest_first())
    if off:
        df = df.offset(off)
    return df.limit(lim) if lim is not None else df


def logs_before(log: DataFrame, before_ts: float, before_id: int, limit: int) -> DataFrame:
    """Keyset page: the ``limit`` newest rows strictly older than (ts, id)."""
    older = (F.col("timestamp") < before_ts) | ((F.col("timestamp") == before_ts) & (F.col("id") < before_id))
    if "dt" in log.columns:                      # stored logs prune the later partitions
        older = older & (F.col("dt") <= epoch_date(F.lit(float(before_ts))))
    return log.filter(older).orderBy(*_newest_first()).limit(limit)


def all_logs(log: DataFrame) -> DataFrame:
    """Every row, newest first (range-partitioned global sort)."""
    return log.orderBy(*_newest_first())


def system_logs_top(system_log: DataFrame, limit: int = 50) -> DataFrame:
    """L4: newest system-log rows."""
    lim, _ = _clamp(limit, 0)
    df = system_log.orderBy(*_newest_first())
    return df.limit(lim) if lim is not None else df


def with_pager(page: DataFrame, limit: int, offset: int) -> DataFrame:
    """has_prev = offset > 0; has_next = the page is full. The window spans one page (at most ``limit``
    rows); without a limit there is no next page and no window."""
    if limit is None or limit < 0:
        return page.withColumn("has_prev", F.lit(offset > 0)).withColumn("has_next", F.lit(False))
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return page.withColumn("has_prev", F.lit(offset > 0)).withColumn("has_next", n == F.lit(limit))


def log_view(log: DataFrame, limit: int = 10, offset: int = 0, time_zone: str = "UTC") -> DataFrame:
    """Rendered recent-activity page."""
    page = recent_logs(log, limit, offset)
    out = page.select(
        "id", "timestamp",
        human_time(F.col("timestamp"), time_zone).alias("timestamp_formatted"),
        "model_id", "backend_url", "status_code",
        D.status_class(F.col("status_code")).alias("status_class"),
        D.fixed_or_dash(F.col("ttft_ms"), 1, "ms").alias("ttft_display"),
        D.thousands(F.col("total_tokens")).alias("tokens_display"),
        F.concat(D.fixed(F.col("duration_ms"), 2), F.lit(" ms")).alias("latency_display"),
        D.fixed_or_dash(F.col("tokens_per_second"), 1, " t/s").alias("speed_display"),
        D.error_preview(F.col("error_message")).alias("details"),
    )
    lim, off = _clamp(limit, offset)
    return with_pager(out, lim if lim is not None else -1, off)


def system_log_view(system_log: DataFrame, limit: int = 20, time_zone: str = "UTC") -> DataFrame:
    """Rendered system-log page."""
    return system_logs_top(system_log, limit).select(
        "id", "timestamp",
        human_time(F.col("timestamp"), time_zone).alias("timestamp_formatted"),
        "level", D.is_error_level(F.col("level")).alias("is_error"),
        "name", "message", "traceback",
    )


def stats_view(log: DataFrame, period: str = "all", as_of: float | None = None) -> DataFrame:
    """Totals card for a period name (F2), raw numbers plus display text."""
    t = stats.totals(log, stats.period_hours(period), as_of)
    regular = D.regular_input(F.col("total_input_tokens"), F.col("total_cached_tokens"))
    return t.select(
        F.lit(D.period_caption(None if period == "all" else period)).alias("caption"),
        *t.columns,
        D.thousands(F.col("total_requests")).alias("requests_display"),
        D.thousands(F.col("total_tokens")).alias("tokens_display"),
        D.thousands(F.col("total_compute_burn")).alias("burn_display"),
        D.thousands(F.col("total_input_tokens")).alias("input_display"),
        D.thousands(regular).alias("regular_input_display"),
        D.thousands(F.col("total_cached_tokens")).alias("cached_display"),
        D.thousands(F.col("total_output_tokens")).alias("output_display"),
        D.fixed_or_dash(F.col("avg_ttft_ms"), 2, " ms").alias("ttft_display"),
        F.when(F.col("avg_duration_ms").isNull(), F.lit(D.DASH))
         .otherwise(F.concat(D.fixed(F.col("avg_duration_ms"), 2), F.lit(" ms"))).alias("latency_display"),
        D.fixed_or_dash(F.col("avg_tokens_per_second"), 2, " t/s").alias("speed_display"),
    )


def model_cards(log: DataFrame) -> DataFrame:
    """Per-model cards (A3 + P3 + P32)."""
    m = stats.model_rollup(log)
    regular = D.regular_input(F.col("total_input_tokens"), F.col("total_cached_tokens"))
    return m.select(
        *m.columns,
        D.thousands(F.col("count")).alias("requests_display"),
        D.thousands(F.col("total_tokens")).alias("tokens_display"),
        D.thousands(F.col("total_compute_burn")).alias("burn_display"),
        D.thousands(F.col("total_input_tokens")).alias("input_display"),
        D.thousands(regular).alias("regular_input_display"),
        D.thousands(F.col("total_cached_tokens")).alias("cached_display"),
        D.thousands(F.col("total_output_tokens")).alias("output_display"),
        D.fixed_or_dash(F.col("avg_ttft_ms"), 2, " ms").alias("ttft_display"),
        D.fixed_or_dash(F.col("avg_duration_ms"), 2, " ms").alias("latency_display"),
        D.fixed_or_dash(F.col("avg_tokens_per_second"), 2, " t/s").alias("speed_display"),
    ).orderBy(F.desc("count"), F.asc("model_id"))


def drop_untracked(log: DataFrame, untracked: DataFrame) -> DataFrame:
    """rows of untracked models are not kept. Applied to the *logged* model
    id, i.e. after fallback resolution (T15). The untracked set comes from
    configuration; it is broadcast only behind a size check."""
    ids = untracked.select("model_id").distinct()
    return log.join(checked_broadcast(ids), "model_id", "left_anti")
