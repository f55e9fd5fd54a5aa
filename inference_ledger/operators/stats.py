"""Usage statistics over the request log: F1-F3, P1-P4, A1-A5, L1, L5.

All aggregates are plain ``groupBy``/``agg`` so Spark plans a partial
(map-side) and a final hash aggregate; the exchange between them carries at
most one row per group per partition, which also absorbs hot models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import SERIES_PERIODS, TOTALS_PERIOD_HOURS, bucket_label, epoch_date

MEASURES = [
    "total_input_tokens", "total_output_tokens", "total_tokens", "total_cached_tokens",
    "total_compute_burn", "avg_ttft_ms", "avg_duration_ms", "avg_tokens_per_second",
]
SUM_MEASURES = MEASURES[:5]
AVG_MEASURES = MEASURES[5:]


def cached_tokens(df_or_none=None) -> Column:
    """Prompt-cache hits plus cache reads; cache *creation* is not counted."""
    return (F.coalesce(F.col("prompt_cached_tokens"), F.lit(0))
            + F.coalesce(F.col("cache_read_input_tokens"), F.lit(0)))


def compute_burn() -> Column:
    """Total minus cached, NULL when total is NULL; never clamped."""
    return F.col("total_tokens") - cached_tokens()


def filter_since(log: DataFrame, since_epoch: float | None) -> DataFrame:
    """Inclusive lower time bound. Emits the matching ``dt`` predicate too, so a
    log stored partitioned by ``dt`` prunes partitions, not only row groups."""
    if since_epoch is None:
        return log
    cond = F.col("timestamp") >= F.lit(float(since_epoch))
    if "dt" in log.columns:
        cond = cond & (F.col("dt") >= epoch_date(F.lit(float(since_epoch))))
    return log.filter(cond)


def filter_hours(log: DataFrame, hours: int | None, as_of: float) -> DataFrame:
    """``hours`` of None or 0 means all time."""
    if not hours:
        return log
    return filter_since(log, as_of - hours * 3600)


def period_hours(period: str) -> int | None:
    """hour=1, day=24, month=720, anything else = all time."""
    return TOTALS_PERIOD_HOURS.get(period)


# The measures as SQL expressions: one parse on the driver instead of one
# round trip per Column operator (P1 cached, P2 burn).
CACHED_SQL = "coalesce(prompt_cached_tokens, 0) + coalesce(cache_read_input_tokens, 0)"
MEASURE_SQL = {
    "total_input_tokens": "sum(prompt_tokens)",
    "total_output_tokens": "sum(completion_tokens)",
    "total_tokens": "sum(total_tokens)",
    "total_cached_tokens": f"sum({CACHED_SQL})",
    "total_compute_burn": f"sum(total_tokens - ({CACHED_SQL}))",
    "avg_ttft_ms": "avg(ttft_ms)",
    "avg_duration_ms": "avg(duration_ms)",
    "avg_tokens_per_second": "avg(tokens_per_second)",
}


def _measure_exprs() -> list[Column]:
    return [F.expr(f"{sql} AS {name}") for name, sql in MEASURE_SQL.items()]


def _zero_fill_when_empty(df: DataFrame, count_col: str) -> DataFrame:
    """A2: only an empty input turns the measures into 0 / 0.0."""
    return df.selectExpr(count_col, *[
        f"CASE WHEN {count_col} = 0 THEN CAST(0 AS BIGINT) ELSE {m} END AS {m}" for m in SUM_MEASURES
    ], *[
        f"CASE WHEN {count_col} = 0 THEN 0.0D ELSE {m} END AS {m}" for m in AVG_MEASURES
    ])


def totals(log: DataFrame, hours: int | None = None, as_of: float | None = None) -> DataFrame:
    """A1 + A2: one row of totals."""
    df = filter_hours(log, hours, as_of) if hours else log
    agg = df.agg(F.expr("count(1) AS total_requests"), *_measure_exprs())
    return _zero_fill_when_empty(agg, "total_requests")


def total_parts(log: DataFrame) -> DataFrame:
    """What ``totals`` needs of a part of the log: counts and sums, no averages. Parts add up."""
    counts = [F.expr(f"count({sql[4:-1]}) AS n_{name}") for name, sql in MEASURE_SQL.items()]
    sums = [F.expr(f"sum({sql[4:-1]}) AS s_{name}") for name, sql in MEASURE_SQL.items()]
    return log.agg(F.expr("count(1) AS total_requests"), *counts, *sums)


def totals_of_parts(parts: DataFrame) -> DataFrame:
    """A1 + A2 from any number of ``total_parts`` rows."""
    whole = parts.agg(F.expr("coalesce(sum(total_requests), 0) AS total_requests"), *[
        F.expr((f"sum(s_{m}) / sum(n_{m})" if m in AVG_MEASURES else f"sum(s_{m})") + f" AS {m}") for m in MEASURE_SQL])
    return _zero_fill_when_empty(whole, "total_requests")


def model_rollup(log: DataFrame, hours: int | None = None, as_of: float | None = None) -> DataFrame:
    """A3 + L1: per-model measures, busiest model first (tie-break on id, T13)."""
    df = filter_hours(log, hours, as_of) if hours else log
    return (df.groupBy("model_id")
              .agg(F.expr("count(1) AS count"), *_measure_exprs())
              .orderBy(F.desc("count"), F.asc("model_id")))


def totals_and_models(log: DataFrame, hours: int | None = None, as_of: float | None = None) -> DataFrame:
    """A4: totals and per-model rows from ONE scan via GROUPING SETS
    ((), (model_id)). ``level`` is 'total' or 'model'."""
    df = filter_hours(log, hours, as_of) if hours else log
    g = df.groupingSets([[], [F.col("model_id")]], F.col("model_id"))
    out = g.agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("requests"), *_measure_exprs())
    return out.select(
        F.when(F.col("_gid") == 1, F.lit("total")).otherwise(F.lit("model")).alias("level"),
        "model_id", "requests", *MEASURES,
    )


def time_series(log: DataFrame, period: str, as_of: float, time_zone: str = "UTC") -> DataFrame:
    """A5 + F3 + P4 + L5: requests / tokens / cached tokens per bucket label.
    Empty buckets are not filled. Unknown period -> empty result, same schema."""
    known = period in SERIES_PERIODS
    _, window_s = SERIES_PERIODS.get(period, SERIES_PERIODS["hour"])
    df = filter_since(log, as_of - window_s)
    if not known:
        df = df.limit(0)
    label = bucket_label(F.col("timestamp"), period if known else "hour", time_zone)
    return (df.groupBy(label.alias("label"))
              .agg(F.count(F.lit(1)).alias("requests"),
                   F.sum("total_tokens").alias("tokens"),
                   F.sum(cached_tokens()).alias("cached_tokens"))
              .orderBy("label"))


def round_averages(df: DataFrame, digits: int) -> DataFrame:
    """Round the float averages (summation order differs between engines)."""
    return df.selectExpr(*[f"round(`{c}`, {digits}) AS `{c}`" if c in AVG_MEASURES else f"`{c}`"
                           for c in df.columns])
