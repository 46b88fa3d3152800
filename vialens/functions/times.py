"""Clocks and calendars as column expressions. Instants are whole seconds in UTC; schedule times may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """Seconds of an ISO 8601 instant with Z, an offset or nothing (UTC); fractions are dropped, others are null."""
    m = lambda g: F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.\d+)?(Z|([+-])(\d{2}):?(\d{2}))?$", g)
    base = F.unix_timestamp(F.try_to_timestamp(F.concat_ws(" ", m(1), m(2)), F.lit("yyyy-MM-dd HH:mm:ss")))
    offset = F.when(m(4) == "", 0).otherwise(m(5).try_cast("int") * 3600 + m(6).try_cast("int") * 60)
    return F.when(m(1) != "", base - F.when(m(4) == "-", -offset).otherwise(offset))


def minute_text(seconds: Column) -> Column:
    """The minute of an instant as ``YYYY-MM-DDTHH:MM:00Z``."""
    return F.date_format(F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(60))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def schedule_seconds(text: Column) -> Column:
    """Seconds of HH:MM:SS, hours beyond 24 allowed; null if malformed."""
    p = F.split(F.trim(text), ":")
    n = lambda k: F.get(p, k).try_cast("int")
    return F.when(F.size(p) == 3, n(0) * 3600 + n(1) * 60 + n(2))


def service_code(service_id: Column) -> Column:
    """0 for working days, 1 for Saturdays, 2 for Sundays and holidays, else null."""
    return F.when(service_id == "U_REG", 0).when(service_id == "S_REG", 1).when(service_id == "D_REG", 2)


def weekday(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(date) - 1
