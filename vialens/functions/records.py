"""Published JSON as column expressions: vehicles, arrivals and arrays of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_string(c: Column) -> Column:
    """A string as JSON, all that must be escaped escaped; null is ``null``."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def json_array(items: Column) -> Column:
    """An array of JSON texts as one JSON array; null is an empty one."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, ","), F.lit("")), F.lit("]"))


def _given(name: str, value: Column) -> Column:
    """``,"name":value``, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f',"{name}":'), value), F.lit(""))


def _named(name: str, column: str) -> Column:
    return F.when(F.col(column).isNotNull(), _given(name, json_string(F.col(column)))).otherwise("")


def vehicle_record(with_line: bool) -> Column:
    """A vehicle of a snapshot. It carries the time of its fix, not an age, so that it stays the same until the next fix."""
    line = _given("line", json_string(F.col("line"))) if with_line else F.lit("")
    return F.concat(
        F.lit('{"id":'), json_string(F.col("id")), line, _given("t", F.col("t").cast("string")),
        _given("lat", F.format_string("%.5f", "lat")), _given("lon", F.format_string("%.5f", "lon")), _given("ph", json_string(F.col("phase"))),
        F.lit(',"brg":'), F.coalesce(F.col("bearing").cast("string"), F.lit("null")),
        _named("dir", "dir"), _named("shp", "shape_id"), _given("alo", F.col("along").cast("string")), _named("ns", "next_stop"),
        _given("spd", F.col("speed_kmh").cast("string")), _given("cnf", F.format_string("%.2f", "conf")), _given("ven", json_string(F.col("vendor"))),
        F.when(F.col("brt"), ',"brt":true').otherwise(""), F.lit("}"),
    )


def arrival_record() -> Column:
    """An arrival as an array: stop, line, headsign, direction, stops away, metres, time of the fix, vehicle, range of seconds from it."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    text = [json_string(F.col(c)) for c in ("stop_id", "line", "to", "dir")]
    return F.concat(F.lit("["), F.concat_ws(",", *text, F.col("stops_away").cast("string"), whole("metres"), F.col("t").cast("string"), json_string(F.col("vehicle")), whole("eta_lo"), whole("eta_hi")), F.lit("]"))
