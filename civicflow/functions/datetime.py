"""Date/time column expressions.

All are plain Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The source system marks "not closed yet" with this year / epoch-ms.
SENTINEL_YEAR = 1900
SENTINEL_EPOCH_MS = -2208988800000
# Resolution times outside [0, MAX_RESOLUTION_DAYS] are implausible and nulled.
MAX_RESOLUTION_DAYS = 1825

# Formats tried in order for string datetimes (ISO-like first).
_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "MM/dd/yyyy hh:mm:ss a",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
)


def parse_datetime(col: str | Column, data_type: T.DataType | None = None) -> Column:
    """Numeric columns are epoch milliseconds, strings are parsed; failures -> null.

    The branch is chosen from the *schema* at plan-build time, never by looking at data.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(data_type, (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.DecimalType)):
        return F.timestamp_millis(c.cast("long")).cast("timestamp_ntz")
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if isinstance(data_type, T.DateType):
        return c.cast("timestamp_ntz")
    s = F.trim(c.cast("string"))
    parsed = [F.try_to_timestamp(s, F.lit(fmt)) for fmt in _FORMATS]
    return F.coalesce(*parsed).cast("timestamp_ntz")


def null_sentinel_date(c: Column) -> Column:
    """A 1900 date means "open"; turn it into null."""
    return F.when(F.year(c) == SENTINEL_YEAR, F.lit(None)).otherwise(c)


def calendar_features(ts: Column) -> dict[str, Column]:
    """S3: calendar columns derived from the request timestamp."""
    return {
        "requested_date": F.to_date(ts),
        "requested_year": F.year(ts),
        "requested_month": F.month(ts),
        "requested_week": F.weekofyear(ts),  # ISO week number
        "requested_day_of_week": F.date_format(ts, "EEEE"),
        "requested_hour": F.hour(ts),
    }


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def resolution_days(requested: Column, closed: Column) -> Column:
    """(closed - requested) in days, rounded to 2, implausible values nulled."""
    days = F.round((epoch_seconds(closed) - epoch_seconds(requested)) / F.lit(86400.0), 2)
    return F.when((days < 0) | (days > MAX_RESOLUTION_DAYS), F.lit(None).cast("double")).otherwise(days)


def week_start(ts: Column) -> Column:
    """Monday of the ISO week holding ``ts``, as a date."""
    return F.to_date(F.date_trunc("week", ts))
