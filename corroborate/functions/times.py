"""Timestamps: UTC, as ISO 8601 texts with an offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The moment an ISO 8601 text names, with `Z` or an offset, or UTC where it has neither; null where it names none."""
    told = F.regexp_replace(F.trim(text), r"[zZ]$", "+00:00")
    whole = told.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?$")
    named = F.when(told.rlike(r"[+-]\d{2}:\d{2}$"), told).otherwise(F.concat(told, F.lit("+00:00")))
    return F.when(whole, named.try_cast("timestamp"))


def formatted(moment: Column) -> Column:
    """The ISO 8601 text in UTC, microseconds where there are any. The session's time zone is taken to be UTC."""
    fine = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(fine, r"\.000000$", ""), F.lit("+00:00"))


def later(moment: Column, seconds: Column) -> Column:
    """When a lease taken at a moment runs out."""
    return moment + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def millis(begin: Column, end: Column) -> Column:
    """Milliseconds between two moments, to a thousandth."""
    return F.round((F.unix_micros(end) - F.unix_micros(begin)) / 1000, 3)
