"""Plane and spherical geometry as column expressions: metres and degrees as doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from vialens.constants import ANCHOR_LAT, ANCHOR_LON, AREA_LAT, AREA_LON, M_PER_LAT, M_PER_LON


def in_area(lat: Column, lon: Column) -> Column:
    return lat.between(*AREA_LAT) & lon.between(*AREA_LON)


def x_of(lon: Column) -> Column:
    return (lon - ANCHOR_LON) * M_PER_LON


def y_of(lat: Column) -> Column:
    return (lat - ANCHOR_LAT) * M_PER_LAT


def lon_of(x: Column) -> Column:
    return x / M_PER_LON + ANCHOR_LON


def lat_of(y: Column) -> Column:
    return y / M_PER_LAT + ANCHOR_LAT


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def on_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The share of a segment (0 to 1) at which it is nearest to a point; 0 on a segment without length."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    return F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(F.lit(0.0))


def bearing(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees clockwise from north, 0 to below 360."""
    return F.pmod(F.degrees(F.atan2(bx - ax, by - ay)) + 360.0, F.lit(360.0))


def bearing_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    n, r = 1 << zoom, F.radians(lat)
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n))).cast("int")


def haversine(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Metres on a sphere of 12,742 km diameter."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 12742000.0 * F.asin(F.sqrt(h))


def ring_area(points: Column) -> Column:
    """Signed area of a ring, an array of structs with x and y: half the sum of cross products of neighbours."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    crossed = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(crossed, F.lit(0.0), lambda a, c: a + c) / 2.0


def loop_delta(start: Column, end: Column, length: Column, circular: Column) -> Column:
    """Metres from one place along a shape to another, the short way round on a loop."""
    d = end - start
    r = d % length
    return F.when(~circular | (length <= 1), d).when(r > length / 2, r - length).when(r < -length / 2, r + length).otherwise(r)


def eta_bounds(ahead: Column, own: Column, line: Column, planned: Column) -> tuple[Column, Column]:
    """Least and most seconds to a stop ``ahead`` metres away: own speed counts by exp(-d/1500), the line's the rest."""
    low, high = 8.0 / 3.6, 40.0 / 3.6
    clamp = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    far = F.greatest(ahead, F.lit(0.0))
    w = F.exp(-far / 1500.0)
    centre = far / clamp(w * F.greatest(own, F.lit(0.0)) + (1.0 - w) * clamp(F.coalesce(line, planned)))
    return 0.7 * centre, 1.4 * centre + 30.0
