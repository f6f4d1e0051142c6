"""Time functions of the progress log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_now() -> Column:
    """The present as ISO 8601 with offset, in seconds."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_iso(s: Column) -> Column:
    """A timestamp from ISO 8601 with an offset or Z; null if it is none."""
    return F.try_to_timestamp(s)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, never below zero."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(1e6))


def percent(current: Column, total: Column) -> Column:
    """Percent done within 0 and 100, to two places half-even; null if the total isn't positive."""
    return F.when(total > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * current / F.when(total > 0, total))), 2))


def clock(seconds: Column) -> Column:
    """MM:SS, or HH:MM:SS from an hour on; empty for null."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")  # 0 for null, which is told apart below
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60, s % 60
    return F.when(seconds.isNull(), "").when(s >= 3600, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def clock_millis(seconds: Column) -> Column:
    """HH:MM:SS.mmm."""
    ms = F.floor(seconds * 1000).cast("bigint")
    s = F.floor(ms / 1000).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(s / 3600).cast("bigint"), F.floor(s / 60).cast("bigint") % 60, s % 60, ms % 1000)
