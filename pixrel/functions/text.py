"""Texts for people and for files: sizes, durations, numbers, headers, CSV and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_format(c: Column) -> Column:
    """Bytes for people: B, KB with one digit, MB with two."""
    return F.when(c < 1024, F.format_string("%d B", c.cast("long"))).when(c < 1024 * 1024, F.format_string("%.1f KB", c / 1024.0)).otherwise(F.format_string("%.2f MB", c / 1024.0 / 1024.0))


def duration_format(ms: Column) -> Column:
    """Milliseconds for people: whole seconds below a minute, else minutes and seconds."""
    s = F.greatest(F.lit(0), F.floor(ms / 1000.0 + 0.5)).cast("long")
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60).cast("long"), s % 60))


def positive_integer(text: Column, fallback: int) -> Column:
    """The whole number that a text begins with, if it is positive, else the fallback."""
    n = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*\+?(\d+)", 1).try_cast("long")
    return F.when((n > 0) & (n <= (1 << 53) - 1), n).otherwise(F.lit(fallback))


def visitor(cookies: Column, name: str) -> Column:
    """The id that a cookie header has under name, if it is 20 to 80 letters, digits, - and _; else null."""
    found = F.regexp_extract(F.coalesce(cookies, F.lit("")), rf"(?:^|;)\s*{name}=([^;]*)", 1)
    return F.when(found.rlike("^[A-Za-z0-9_-]{20,80}$"), found)


def forwarded_for(header: Column) -> Column:
    """The first address of a forwarding header."""
    return F.nullif(F.substring(F.trim(F.split(F.coalesce(header, F.lit("")), ",")[0]), 1, 128), F.lit(""))


def csv_field(c: Column) -> Column:
    """A value in quotes, quotes doubled; null is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def iso_time(ms: Column) -> Column:
    """Milliseconds since 1970 as a timestamp in UTC with milliseconds and Z."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
