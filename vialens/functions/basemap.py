"""What a map of streets, water and green draws, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of land drawn green and as sand, and water left out. They have to be these for right results.
GREEN = [
    "park", "wood", "forest", "scrub", "grass", "garden", "nature_reserve", "golf_course", "recreation_ground", "cemetery",
    "grassland", "meadow", "heath", "national_park", "protected_area", "village_green",
]
SAND = ["beach", "sand"]
NO_WATER = ["fountain", "swimming_pool"]
POLYGON, LINE, POINT = 3, 2, 1
# The zooms drawn, the grid of a tile, tolerances of simplification, and the least stretch that carries a name.
ZOOMS, GRID, LABEL_ZOOM, LABEL_LEAST, ROAD_TOLERANCE = [11, 13, 15], 1024.0, 15, 90.0, 1.4
# Kinds of named places in the order of their rank, and the metres within which a name is shown once.
PLACES = {"locality": 0, "macrohood": 1, "neighbourhood": 2, "suburb": 2}
PLACE_APART_M = 1000.0


def drawn_as(layer: Column, geometry: Column, kind: Column, zoom: Column) -> Column:
    """The part of the map that a feature is drawn in (water, green, sand, road0 to road2), or null for those left out."""
    land = layer.isin("landuse", "landcover") & (geometry == POLYGON)
    road = (layer == "roads") & (geometry == LINE)
    return (
        F.when((layer == "water") & (geometry == POLYGON) & ~kind.isin(NO_WATER), "water")
        .when(land & kind.isin(GREEN), "green")
        .when(land & kind.isin(SAND), "sand")
        .when(road & (kind == "highway"), "road0")
        .when(road & kind.isin("major_road", "medium_road"), "road1")
        .when(road & (kind == "minor_road") & (zoom >= 13), "road2")
    )


def least_area(part: Column, zoom: Column) -> Column:
    """The area under which a polygon of a part is left out."""
    return F.when(part == "water", 20.0).when(part == "sand", 40.0).when(part == "green", F.when(zoom >= 15, 120.0).otherwise(60.0))


def label_angle(dx: Column, dy: Column) -> Column:
    """Degrees of a stretch folded to -90..90, so that its name never stands on its head."""
    a = F.degrees(F.atan2(dy, dx))
    return F.when(a > 90, a - 180).when(a < -90, a + 180).otherwise(a)


def tolerance(part: Column, zoom: Column) -> Column:
    """How far a line of a part may be off after simplification, in grid steps."""
    return F.when(part.startswith("road"), ROAD_TOLERANCE).when(zoom >= 15, 2.0).otherwise(1.4)


def place_rank(kind: Column) -> Column:
    """The rank of a named place, least first; null for kinds that are not named."""
    return F.coalesce(*(F.when(kind == k, r) for k, r in PLACES.items()))


def lon_of_tile(x: Column, zoom: Column) -> Column:
    """The longitude of a place in tiles (with its share of a tile) of a zoom."""
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def lat_of_tile(y: Column, zoom: Column) -> Column:
    """The latitude of a place in tiles of a zoom: the inverse of the spherical Mercator projection."""
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))
