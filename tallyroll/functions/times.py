"""Zone-free time helpers over TIMESTAMP_NTZ columns."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ts(value: str | datetime | Column) -> Column:
    """Literal (or column) as a zone-free timestamp."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, datetime) else value
    return F.lit(text).cast("timestamp_ntz")


def seconds(n: int | float) -> Column:
    """Constant day-time interval of ``n`` seconds."""
    return F.lit(timedelta(seconds=n))


def millis(n: int) -> Column:
    return F.lit(timedelta(milliseconds=n))


def hours(n: int) -> Column:
    return F.lit(timedelta(hours=n))


def plus(at: Column, n: Column, unit: str) -> Column:
    """``at`` moved by a column of whole units."""
    return F.timestamp_add(unit, n, at)


def micros_between(start: Column, end: Column) -> Column:
    """Signed microseconds from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", start, end)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, truncated toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def epoch_millis_to_local(ms: Column, zone: str = "Asia/Seoul") -> Column:
    """Epoch milliseconds as wall-clock time in ``zone``."""
    return convert_local(plus(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ms, "MILLISECOND"), zone)


def local_to_offset_text(local: Column, zone: str = "Asia/Seoul") -> Column:
    """Wall-clock time in ``zone`` as ISO text with its UTC offset."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    offset_minutes = F.timestamp_diff("MINUTE", utc, local)
    sign = F.when(offset_minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    size = F.abs(offset_minutes)
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        sign,
        F.lpad(F.floor(size / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((size % 60).cast("string"), 2, "0"),
    )


def convert_local(utc: Column, zone: str = "Asia/Seoul") -> Column:
    """Zone-free UTC time as wall-clock time in ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
