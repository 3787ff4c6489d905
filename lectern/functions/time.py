"""Times and durations, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_checkpoint_ts(text: Column) -> Column:
    """ISO 8601 where there is a T (a Z or an offset is accepted), else date and time with a space;
    null where neither is met."""
    plain = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(text.contains("T"), text.try_cast("timestamp")).otherwise(plain)


def ts_parts(ts: Column) -> Column:
    """Date, time and a readable form; ``Unknown`` where there is none."""
    form = lambda pattern: F.coalesce(F.date_format(ts, pattern), F.lit("Unknown"))
    return F.struct(form("yyyy-MM-dd").alias("date"), form("HH:mm:ss").alias("time"), form("MMM dd, yyyy 'at' hh:mm:ss a").alias("readable"))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def human_duration(seconds: Column, whole: bool = False, summary: bool = False) -> Column:
    """``12.3s``, ``4m 5s`` or ``2h 3m``. ``whole``: seconds without a fraction. ``summary``: a minute
    or an hour to the second still counts as the smaller unit."""
    below = (lambda limit: seconds <= limit) if summary else (lambda limit: seconds < limit)
    whole_part = lambda x: F.floor(x).cast("bigint").cast("string")
    short = F.concat(seconds.cast("bigint").cast("string"), F.lit("s")) if whole else F.format_string("%.1fs", seconds)
    minutes = F.concat(whole_part(seconds / 60), F.lit("m "), whole_part(seconds % 60), F.lit("s"))
    hours = F.concat(whole_part(seconds / 3600), F.lit("h "), whole_part((seconds % 3600) / 60), F.lit("m"))
    return F.when(below(60), short).when(below(3600), minutes).otherwise(hours)


def hms_centis(seconds: Column) -> Column:
    """HH:MM:SS.cc, hundredths cut off."""
    whole = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ((seconds - whole) * 100).cast("bigint"))
