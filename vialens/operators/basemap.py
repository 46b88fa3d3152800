"""The map build: rings that are kept, labels of roads, tiles assembled from features, and named places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.constants import AREA_LAT, AREA_LON
from vialens.functions import basemap, folds, geo, records
from vialens.operators.stored import stored


def kept_rings(rings: DataFrame, feature: str | list[str], order: str, least: float | Column) -> DataFrame:
    """Rings (``feature``, ``order``, ``area``, ``points``) that are drawn: an outer ring (area above 0) of ``least`` at least,
    and a hole as large if the outer ring before it is drawn. Rings of under three points are not."""
    before = Window.partitionBy(*([feature] if isinstance(feature, str) else feature)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outer = F.last(F.when(F.col("area") > 0, F.col("area") >= least), ignorenulls=True).over(before)
    return rings.withColumn("__outer", outer).where(F.coalesce("__outer", F.lit(False)) & (F.abs("area") >= least) & (F.col("points") >= 3)).drop("__outer")


def road_labels(points: DataFrame, least: float) -> DataFrame:
    """A label for each name and tile from road points (road, tile, name, i, x, y): each road's longest straight stretch, the
    first of equals, if it is longer than ``least``; of a name's roads in a tile the first. Adds its middle and angle."""
    along = Window.partitionBy("road").orderBy("i")
    p = points.select("*", F.lead("x").over(along).alias("nx"), F.lead("y").over(along).alias("ny")).where("nx is not null")
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    p = p.withColumn("d", F.sqrt(dx * dx + dy * dy))
    stretch = F.struct((F.col("x") + F.col("nx")).alias("sx"), (F.col("y") + F.col("ny")).alias("sy"), dx.alias("dx"), dy.alias("dy"))
    best = p.groupBy("road", "tile", "name").agg(F.max_by(stretch, F.struct("d", -F.col("i"))).alias("s"), F.max("d").alias("d")).where(F.col("d") > least)
    first = best.groupBy("tile", "name").agg(F.min_by("s", "road").alias("s"), F.min("road").alias("road"))
    return first.select(
        "tile", "name", "road", F.round(F.col("s.sx") / 2).cast("int").alias("x"), F.round(F.col("s.sy") / 2).cast("int").alias("y"),
        F.round(basemap.label_angle(F.col("s.dx"), F.col("s.dy"))).cast("int").alias("angle"),
    )


_TILE = ["z", "x", "y"]


def _sorted(rows: DataFrame, order: list[str], body: str) -> DataFrame:
    """A JSON array of ``body`` for each tile and part, in ``order``; a tile holds what a screen shows."""
    items = F.array_sort(F.collect_list(F.struct(*order, body)))
    return rows.groupBy(*_TILE, "part").agg(records.json_array(F.transform(items, lambda i: i[body])).alias("body"))


def _polygons(lines: DataFrame) -> DataFrame:
    ring = F.transform("p", lambda q: F.struct((q["x"] * basemap.GRID / F.col("extent")).alias("x"), (q["y"] * basemap.GRID / F.col("extent")).alias("y")))
    rings = lines.where(~F.col("part").startswith("road")).select(*_TILE, "ix", "part", "k", "flat", geo.ring_area(ring).alias("area"), F.floor(F.size("flat") / 2).alias("points"))
    kept = kept_rings(rings, [*_TILE, "ix"], "k", basemap.least_area(F.col("part"), F.col("z")))
    whole = kept.groupBy(*_TILE, "part", "ix").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "flat"))), lambda r: r["flat"])).alias("rings"))
    return _sorted(whole, ["ix"], "rings")


def _roads(lines: DataFrame) -> DataFrame:
    rows = lines.where(F.col("part").startswith("road") & (F.size("flat") >= 4)).withColumn("path", F.to_json("flat"))
    return _sorted(rows, ["ix", "k"], "path")


def _labels(lines: DataFrame) -> DataFrame:
    """Names of main roads at the largest zoom: on each road's longest straight stretch if its middle is in the tile; one a name and tile."""
    roads = lines.where((F.col("z") == basemap.LABEL_ZOOM) & F.col("part").isin("road0", "road1") & F.col("name").isNotNull() & (F.size("flat") >= 4))
    at = lambda i: F.get("line", i)

    def stretch(i: Column) -> Column:
        dx, dy = at(2 * i + 2) - at(2 * i), at(2 * i + 3) - at(2 * i + 1)
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), (-i).alias("o"), ((at(2 * i) + at(2 * i + 2)) / 2.0).alias("mx"), ((at(2 * i + 1) + at(2 * i + 3)) / 2.0).alias("my"), basemap.label_angle(dx, dy).alias("angle"))

    longest = F.array_max(F.transform(F.sequence(F.lit(0), F.floor(F.size("line") / 2).cast("int") - 2), stretch))
    best = roads.groupBy(*_TILE, "ix", "name", "part").agg(F.max_by(longest, F.struct(longest["d"], -F.col("k"))).alias("s"))
    inside = F.col("s.mx").between(0, basemap.GRID) & (F.col("s.mx") < basemap.GRID) & F.col("s.my").between(0, basemap.GRID) & (F.col("s.my") < basemap.GRID)
    first = best.where((F.col("s.d") > basemap.LABEL_LEAST) & inside).groupBy(*_TILE, "name").agg(F.min_by(F.struct("s", "part"), "ix").alias("l"))
    whole = [F.round(F.col(f"l.s.{c}")).cast("int").cast("string") for c in ("mx", "my", "angle")]
    body = F.concat(F.lit("["), F.concat_ws(",", *whole, records.json_string(F.col("name")), F.when(F.col("l.part") == "road0", "0").otherwise("1")), F.lit("]"))
    return _sorted(first.select(*_TILE, F.lit("label").alias("part"), "name", body.alias("label")), ["name"], "label")


def map_tiles(features: DataFrame) -> DataFrame:
    """``z, x, y, body``: what a map draws of each tile, as JSON. Tiles of which nothing is drawn are left out.

    ``features`` as ``archive.tile_features`` gives them. Lines and rings are scaled to the tile's grid, simplified, put on whole
    steps and rid of repeated points; a ring that has under three points left, or a road under two, is not drawn.
    """
    kind = F.coalesce(F.col("props")["kind"], F.lit(""))
    drawn = features.withColumn("part", basemap.drawn_as(F.col("layer"), F.col("geom_type"), kind, F.col("z"))).where("part is not null")
    lines = drawn.select(*_TILE, "ix", "part", F.col("props")["name"].alias("name"), "extent", F.posexplode("parts").alias("k", "p"))
    lines = lines.withColumn("g", folds.on_grid("p", F.lit(basemap.GRID), "extent", basemap.tolerance(F.col("part"), F.col("z"))))
    road = F.col("part").startswith("road")  # only roads are named along their line, and only rings have an area
    lines = lines.select(*_TILE, "ix", "part", "name", "extent", "k", F.when(~road, F.col("p")).alias("p"), F.when(road, F.col("g.line")).alias("line"), "g.flat")
    lines = stored(lines, "lines")  # rings, roads and labels read it
    every = _polygons(lines).union(_roads(lines)).union(_labels(lines))
    names = {"water": "w", "green": "g", "sand": "s", "road0": "r0", "road1": "r1", "road2": "r2", "label": "l"}
    of = {p: F.max(F.when(F.col("part") == p, F.col("body"))).alias(p) for p in names}
    tiles = every.groupBy(*_TILE).agg(*of.values()).where(reduce(lambda a, b: a | b, (F.col(p).isNotNull() for p in names if p != "label")))
    body = F.concat_ws(",", *(F.concat(F.lit(f'"{n}":'), F.col(p)) for p, n in names.items()))
    return tiles.select(*_TILE, F.concat(F.lit("{"), body, F.lit("}")).alias("body"))


def save_tiles(tiles: DataFrame, path: str) -> None:
    """Map tiles as a table in folders of zoom and column: a reader of one column of a zoom opens that folder only."""
    tiles.repartition("z", "x").sortWithinPartitions("y").write.partitionBy("z", "x").parquet(path)


def named_places(features: DataFrame) -> DataFrame:
    """``name, rank, lat, lon, tile_id, ix`` of the places in the served area that a map names."""
    rank = basemap.place_rank(F.col("props")["kind"])
    first = F.get(F.get("parts", F.lit(0)), F.lit(0))
    rows = features.where((F.col("layer") == "places") & (F.col("geom_type") == basemap.POINT) & rank.isNotNull() & F.col("props")["name"].isNotNull() & first.isNotNull())
    lat, lon = basemap.lat_of_tile(F.col("y") + first["y"] / F.col("extent"), F.col("z")), basemap.lon_of_tile(F.col("x") + first["x"] / F.col("extent"), F.col("z"))
    rows = rows.select(F.col("props")["name"].alias("name"), rank.alias("rank"), lat.alias("lat"), lon.alias("lon"), "tile_id", "ix")
    return rows.where(F.col("lat").between(*AREA_LAT) & F.col("lon").between(*AREA_LON))


def ranked_places(places: DataFrame, apart: float = basemap.PLACE_APART_M) -> DataFrame:
    """Of the places of one name, the most important first, those not within ``apart`` metres of one kept before.

    ``places``: name, rank, lat, lon, and ``tile_id, ix`` to order equals. A name stands on some tiles of each zoom, so a name's
    places fit in an array.
    """
    at = F.struct("rank", "tile_id", "ix", geo.x_of(F.col("lon")).alias("x"), geo.y_of(F.col("lat")).alias("y"), "lat", "lon")
    held = places.groupBy("name").agg(F.array_sort(F.collect_list(at)).alias("p"))
    # the fold carries a place's number in its name's order
    numbered = F.transform("p", lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), i.cast("long").alias("id")))
    kept = held.select("name", "p", F.explode(folds.keep_apart(numbered, apart)).alias("k"))
    return kept.select("name", F.get("p", F.col("k.id").cast("int")).alias("q")).select("name", "q.rank", "q.lat", "q.lon", "q.tile_id", "q.ix")


def map_documents(features: DataFrame) -> DataFrame:
    """``path, body`` of a map: ``z/x/y.json`` for each drawn tile, and ``places.json`` with ``[lon, lat, name, rank]`` in order of rank and name."""
    tiles = map_tiles(features).select(F.concat_ws("/", "z", "x", F.concat("y", F.lit(".json"))).alias("path"), "body")
    degrees = lambda c: (F.round(F.col(c) * 1e5) / 1e5).cast("string")
    item = F.concat(F.lit("["), F.concat_ws(",", degrees("lon"), degrees("lat"), records.json_string(F.col("name")), F.col("rank").cast("string")), F.lit("]"))
    one = ranked_places(named_places(features)).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "tile_id", "ix", item.alias("item")))).alias("v"))
    return tiles.union(one.select(F.lit("places.json").alias("path"), records.json_array(F.transform("v", lambda i: i["item"])).alias("body")))
