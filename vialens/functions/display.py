"""Texts for riders: distances, walks, ages, route names, search keys and line states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metres_text(m: Column) -> Column:
    return F.when(m >= 1000, F.concat(F.replace(F.format_string("%.1f", m / 1000), F.lit("."), F.lit(",")), F.lit(" km"))).otherwise(F.concat(F.round(m).cast("long").cast("string"), F.lit(" m")))


def walk_text(m: Column) -> Column:
    return F.concat(F.greatest(F.lit(1), F.round(m / 75)).cast("long").cast("string"), F.lit(" min"))


def age_text(s: Column) -> Column:
    return F.concat((s / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(" atrás"))


def route_name(name: Column) -> Column:
    """``a - b`` shown as ``a x b``."""
    return F.regexp_replace(name, r"\s+-\s+", " x ")


def search_key(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def boarding_cost(walk_m: Column, headway_min: Column) -> Column:
    """Minutes to board: the walk at 75 m a minute and half a headway; 1,000 without service."""
    return walk_m / 75.0 + F.coalesce(headway_min / 2.0, F.lit(1000.0))


def url_encoded(text: Column) -> Column:
    """Percent encoding of all but unreserved characters."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def house_number(text: Column) -> Column:
    """The house number of an address, empty for names such as ``7 de Setembro``."""
    return F.regexp_extract(text, r"(?i)\b(\d+)\b(?!\s+de\s)", 1)


def line_state(live: Column, headway_min: Column, next_hour: Column) -> Column:
    """What a rider is told about a line now."""
    return F.when(live > 0, F.format_string("%d buses live", live)).when(headway_min.isNotNull(), F.format_string("every %d min, none live", headway_min)).when(next_hour.isNotNull(), F.format_string("starts at %02d:00", next_hour)).otherwise("no service today")


def search_lookup(typed: Column) -> Column:
    """The key under which the answer to a typed search is kept; null for what is too short to be searched for."""
    q = search_key(typed)
    return F.when(F.length(q) >= 3, F.concat(F.lit("s:"), q))


def reverse_lookup(lat: Column, lon: Column) -> Column:
    """The key under which the address of a place is kept: places some 11 m apart share it."""
    return F.concat(F.lit("r:"), F.format_string("%.4f", lat), F.lit(","), F.format_string("%.4f", lon))
