"""Numbers from timestamps, the same whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp without zone."""
    days = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + micros


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a timestamp without zone."""
    return F.floor(epoch_micros(ts) / 1_000_000).cast("long")


def month_index(ts: Column, base_year: int) -> Column:
    """Months since January of the base year."""
    return ((F.year(ts) - base_year) * 12 + F.month(ts) - 1).cast("int")


def day_index(ts: Column, base: str) -> Column:
    """Days since a date."""
    return F.date_diff(F.to_date(ts), F.lit(base).cast("date")).cast("int")
