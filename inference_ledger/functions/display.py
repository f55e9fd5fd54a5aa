"""Display expressions of the dashboard views: P3, P31, P32, F10, F11.

Fixed-decimal text is built from an integer scaled value (``round(x * 10^d)``)
so the text is identical on every engine; Python's ``%.2f`` rounds the binary
value half-even, which differs only on exact binary ties (T11). Numeric columns
stay unformatted next to the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "--"


def thousands(x: Column) -> Column:
    """``{:,}`` of an integer; ``--`` only when NULL."""
    return F.when(x.isNull(), F.lit(DASH)).otherwise(F.format_number(x.cast("bigint"), 0))


def fixed(x: Column, digits: int) -> Column:
    """``%.{digits}f`` text of a non-NULL double (half-up on the scaled value)."""
    scale = 10 ** digits
    scaled = F.round(F.abs(x) * F.lit(float(scale))).cast("bigint")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    whole = F.floor(scaled / F.lit(scale)).cast("bigint").cast("string")
    frac = F.lpad((scaled % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(sign, whole, F.lit("."), frac)


def fixed_or_dash(x: Column, digits: int, suffix: str) -> Column:
    """``--`` when NULL **or 0** (template truthiness), else fixed + suffix."""
    return F.when(x.isNull() | (x == 0), F.lit(DASH)).otherwise(F.concat(fixed(x, digits), F.lit(suffix)))


def status_class(status: Column) -> Column:
    """exactly 200 is a success."""
    return F.when(status == 200, F.lit("success")).otherwise(F.lit("error"))


def is_error_level(level: Column) -> Column:
    """ERROR and CRITICAL are flagged."""
    return level.isin("ERROR", "CRITICAL")


def error_preview(msg: Column, width: int = 100) -> Column:
    """First ``width`` characters plus ``...`` if longer; ``OK`` if none."""
    return (F.when(msg.isNull() | (msg == ""), F.lit("OK"))
            .when(F.char_length(msg) > width, F.concat(F.substring(msg, 1, width), F.lit("...")))
            .otherwise(msg))


def regular_input(input_tokens: Column, cached: Column) -> Column:
    """Input minus cached, on aggregated values."""
    return input_tokens - cached


def period_caption(period: str | None) -> str:
    """Caption of the totals card."""
    return period.replace("_", " ") if period else "all time"
