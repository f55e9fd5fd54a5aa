"""Epoch/timestamp conversions and time-bucket labels.

The request log stores ``timestamp`` as DOUBLE epoch seconds. Labels are built
from a TIMESTAMP_NTZ holding the wall clock of an explicit time zone, so results
do not depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# fixed values: time-series grains -> (label pattern, retention seconds)
SERIES_PERIODS = {
    "hour": ("yyyy-MM-dd HH:00", 24 * 3600),
    "day": ("yyyy-MM-dd", 30 * 24 * 3600),
    "month": ("yyyy-MM", 365 * 24 * 3600),
}

# fixed values: totals period names -> hours (anything else = all time)
TOTALS_PERIOD_HOURS = {"hour": 1, "day": 24, "month": 24 * 30}


def epoch_seconds(ts: Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) -> DOUBLE epoch seconds, exact to the µs."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), ts.cast("timestamp_ntz")) / F.lit(1_000_000.0)


def epoch_micros(epoch: Column) -> Column:
    return F.round(epoch * F.lit(1_000_000.0)).cast("bigint")


def wall_clock(epoch: Column, time_zone: str = "UTC") -> Column:
    """DOUBLE epoch seconds -> TIMESTAMP_NTZ wall clock in ``time_zone``."""
    utc = F.timestamp_add("MICROSECOND", epoch_micros(epoch), F.expr(_EPOCH_NTZ))
    if time_zone.upper() in ("UTC", "Z", "+00:00"):
        return utc
    return F.convert_timezone(F.lit("UTC"), F.lit(time_zone), utc)


def bucket_label(epoch: Column, period: str, time_zone: str = "UTC") -> Column:
    """``YYYY-MM-DD HH:00`` / ``YYYY-MM-DD`` / ``YYYY-MM`` of the epoch."""
    pattern, _ = SERIES_PERIODS[period]
    return F.date_format(wall_clock(epoch, time_zone), pattern)


def human_time(epoch: Column, time_zone: str = "UTC") -> Column:
    """P5: ``YYYY-MM-DD HH:MM:SS``."""
    return F.date_format(wall_clock(epoch, time_zone), "yyyy-MM-dd HH:mm:ss")


def epoch_date(epoch: Column) -> Column:
    """UTC date of an epoch: the ``dt`` partition value of the request log."""
    return F.to_date(wall_clock(epoch, "UTC"))


def duration_ms(start: Column, end: Column) -> Column:
    """(end - start) in milliseconds for two timestamps."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1000.0)
