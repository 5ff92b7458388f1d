"""Time semantics as column expressions; "now" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO-8601 instant, null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def decay(as_of: Column, then: Column, days: float = 30.0) -> Column:
    """exp(-age / days)."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6
    return F.exp(-age / (days * 86400))


def local_day(ts: Column, zone: str = "Asia/Tokyo") -> Column:
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")
