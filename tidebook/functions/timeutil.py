"""Calendar helpers. All stored instants are UTC; business days are local days."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

KST = "Asia/Seoul"


def as_ts(value: str | Column) -> Column:
    return F.to_timestamp(F.lit(value)) if isinstance(value, str) else value


def local_ts(ts: Column | str, tz: str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts if tz == "UTC" else F.from_utc_timestamp(ts, tz)


def local_day(ts: Column | str, tz: str, boundary_hours: int = 0) -> Column:
    """Business date of an instant; a day may start `boundary_hours` after local midnight."""
    shifted = local_ts(ts, tz)
    if boundary_hours:
        shifted = shifted - F.expr(f"INTERVAL {boundary_hours} HOURS")
    return F.to_date(shifted)


def hour_of(ts: Column | str) -> Column:
    return F.date_trunc("hour", F.col(ts) if isinstance(ts, str) else ts)


def hours_ago(as_of: str | Column, hours: int) -> Column:
    return as_ts(as_of) - F.expr(f"INTERVAL {hours} HOURS")


def hour_number(ts: Column | str) -> Column:
    """Whole hours since the epoch: consecutive hours differ by one."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(ts) / 3600)


def day_number(day: Column | str) -> Column:
    """Days since the epoch."""
    day = F.col(day) if isinstance(day, str) else day
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def seconds_between(end: Column, start: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / 1e6


def iso_dow(day: Column | str) -> Column:
    """Monday is 1, Sunday is 7."""
    day = F.col(day) if isinstance(day, str) else day
    return F.weekday(day) + 1
