"""Schedule feeds as comma-separated files: all columns as strings, missing files and columns as empty ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# The files and columns of a public-transport schedule feed that are read.
COLUMNS = {
    "feed_info": ["feed_version", "feed_start_date"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type", "route_color", "route_text_color"],
    "trips": ["trip_id", "route_id", "direction_id", "shape_id", "trip_headsign", "service_id"],
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "shapes": ["shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled"],
    "stop_times": ["trip_id", "stop_sequence", "stop_id", "shape_dist_traveled", "arrival_time"],
    "frequencies": ["trip_id", "start_time", "end_time", "headway_secs"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
}
OPTIONAL = {"feed_info", "frequencies", "calendar", "calendar_dates"}


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a CSV file with a header, quoted fields, doubled quotes and line breaks in quotes; a mark at the
    file's start is dropped, blank lines are skipped, and a missing column or value reads as an empty string."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    have = {c.lstrip("﻿").strip(): c for c in raw.columns}
    return raw.select(*((F.coalesce(F.col(f"`{have[c]}`"), F.lit("")) if c in have else F.lit("")).alias(c) for c in columns))


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All files of a feed by name; optional ones that are missing are empty tables."""
    out = {}
    for name, columns in COLUMNS.items():
        try:
            out[name] = read_csv(spark, f"{folder}/{name}.txt", columns)
        except AnalysisException:
            if name not in OPTIONAL:
                raise
            out[name] = spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    if out["routes"].isEmpty():
        raise ValueError("the feed has no routes")
    return out
