"""Ages and timestamps; the current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysieve.functions.text import or_null, stripped, text

EPOCH_MS_FROM = 1e11
MAX_EPOCH_S = 253_402_300_799


def age_days(c: Column, today: Column) -> Column:
    """Days from '3d' or a date; null if neither; not below 0."""
    t = stripped(text(c))
    days = or_null(F.regexp_extract(t, r"(?i)^(\d+)\s*d$", 1)).cast("int")
    date = F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t), "yyyy-MM-dd")
    return F.coalesce(days, F.when(date.isNotNull(), F.greatest(F.datediff(today, date), F.lit(0))))


def epoch_timestamp(c: Column) -> Column:
    """A timestamp from epoch seconds or, beyond 1e11, milliseconds; null out of range."""
    n = c.try_cast("double")
    seconds = F.when(n > EPOCH_MS_FROM, n / 1000).otherwise(n)
    return F.when(seconds.between(-62_135_596_800, MAX_EPOCH_S), F.timestamp_micros(F.floor(seconds * 1_000_000).cast("long")))


def relative_days(c: Column) -> Column:
    """Days from 'Posted Today', 'Posted Yesterday' or 'Posted 3 Days Ago'; null otherwise."""
    t = F.lower(text(c))
    return F.when(t.contains("today"), 0).when(t.contains("yesterday"), 1).otherwise(or_null(F.regexp_extract(t, r"(\d+)\+?\s+days?\s+ago", 1)).cast("int"))


def relative_time(seconds: Column) -> Column:
    """'4h ago' from an age in seconds."""
    half_up = lambda x: F.floor(x + 0.5)
    minutes = F.greatest(half_up(seconds / 60), F.lit(0))
    hours = half_up(minutes / 60)
    days = half_up(hours / 24)
    shown = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, shown(minutes, "m ago"))
        .when(hours < 24, shown(hours, "h ago"))
        .when(days < 30, shown(days, "d ago"))
        .otherwise(shown(half_up(days / 30), "mo ago"))
    )


def full_timestamp(c: Column) -> Column:
    return F.date_format(c, "MMM d, yyyy, h:mm a")
