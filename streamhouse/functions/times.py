"""Time conversions between strings, epoch milliseconds and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND_PATTERN = "yyyy-MM-dd HH:mm:ss"
DAY_PATTERN = "yyyyMMdd"
YEAR_MS = 365 * 24 * 3600 * 1000


def event_time(ts_ms: Column) -> Column:
    """Epoch milliseconds to a timestamp usable as event time."""
    return F.timestamp_millis(ts_ms)


def to_epoch_ms(text: Column, offset: str | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to epoch milliseconds, in the session zone or at a fixed offset.

    Text of another form gives null.
    """
    if offset is None:
        return F.unix_millis(F.try_to_timestamp(text, F.lit(SECOND_PATTERN)))
    shifted = F.concat(text, F.lit(f" {offset}"))
    return F.unix_millis(F.try_to_timestamp(shifted, F.lit(f"{SECOND_PATTERN} XXX")))


def created_at(df: DataFrame, text: str = "create_time") -> Column:
    """Creation time of wide rows: ``event_time`` where it is still at hand, else parsed."""
    if "event_time" in df.columns:
        return F.col("event_time")
    return F.try_to_timestamp(F.col(text), F.lit(SECOND_PATTERN))


def to_second_text(ts: Column) -> Column:
    return F.date_format(ts, SECOND_PATTERN)


def day_of(ts_ms: Column) -> Column:
    """Epoch milliseconds to ``yyyyMMdd`` in the session zone."""
    return F.date_format(event_time(ts_ms), DAY_PATTERN)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.from_unixtime(seconds, SECOND_PATTERN)


def now_ms() -> Column:
    """Processing time in whole seconds, as milliseconds."""
    return F.unix_timestamp() * F.lit(1000)


def age_in_years(birthday: Column, as_of: Column) -> Column:
    """Whole 365-day years from a ``yyyy-MM-dd`` birthday to ``as_of``, truncated toward zero."""
    lived_ms = F.unix_millis(as_of) - F.unix_millis(F.try_to_timestamp(birthday, F.lit("yyyy-MM-dd")))
    return (lived_ms / F.lit(YEAR_MS)).cast("int")


def interval_ms(ms: int) -> Column:
    return F.expr(f"INTERVAL {ms} MILLISECONDS")
