"""Dates as text: tolerant parsing without time zones, days, ages, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats, in this order.
FORMATS = ("yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm")
CSV_FORMATS = ("dd.MM.yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd", "yyyy-MM-dd'T'HH")


def _local(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse(text: Column) -> Column:
    """Wall-clock time as TIMESTAMP_NTZ; an offset keeps its wall clock; null if nothing fits."""
    bare = F.regexp_replace(F.trim(text), "(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    clean = F.when(text.rlike("T[0-9:.]+(Z|[+-][0-9]{2}:?[0-9]{2})$"), bare).otherwise(F.trim(text))
    return F.coalesce(*[_local(clean, f) for f in (*FORMATS, *ISO_FORMATS)])


def event_day(updated: Column, created: Column) -> Column:
    """Day of the update, or of the creation where no update is given; null if that cannot be parsed."""
    return F.date_format(parse(F.when(F.coalesce(updated, F.lit("")) != "", updated).otherwise(created)), "yyyy-MM-dd")


def canonical(text: Column) -> Column:
    """The CSV formats as ISO minutes; other text as it is; null if empty."""
    parsed = F.coalesce(*[_local(text, f) for f in CSV_FORMATS])
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm"), text))


def minutes_since(text: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(parse(text))) / 60)).cast("long")


def retry_time(now: Column, attempts: Column) -> Column:
    """2 to the power of the attempts, in minutes, after ``now``."""
    return F.timestamp_seconds(F.unix_timestamp(now) + 60 * F.pow(F.lit(2), attempts).cast("long"))
