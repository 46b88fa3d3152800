"""What a publishing cycle writes of one snapshot: documents by line, by map cell, of the whole fleet, and an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens import constants as C
from vialens.functions import codes, geo, records

ROOT = "api/v1"
#: Arrivals of one line and direction that a stop shows.
PER_LINE = 3
_IDLE = ("stale", "parked", "garage")


def cells(spark: SparkSession, zoom: int) -> DataFrame:
    """``cx, cy`` of every map cell of the served area."""
    corner = spark.range(1).select(geo.tile_x(F.lit(C.AREA_LON[0]), zoom).alias("x0"), geo.tile_x(F.lit(C.AREA_LON[1]), zoom).alias("x1"), geo.tile_y(F.lit(C.AREA_LAT[1]), zoom).alias("y0"), geo.tile_y(F.lit(C.AREA_LAT[0]), zoom).alias("y1"))
    return corner.withColumn("cx", F.explode(F.sequence("x0", "x1"))).select("cx", F.explode(F.sequence("y0", "y1")).alias("cy"))


def _bodies(rows: DataFrame, keys: list[str], order: list[str], record: Column) -> DataFrame:
    """``keys, body``: the records of each key as one array in ``order``. A key's records are one line's, cell's or fleet's."""
    item = F.struct(*order, record.alias("record"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("v")).select(*keys, records.json_array(F.transform("v", lambda x: x["record"])).alias("body"))


def line_documents(snapshot: DataFrame, lines: DataFrame) -> DataFrame:
    """A document for each known line (``line``), empty ones included, and for each line seen that is not known. Lines whose
    names become the same file name share its document."""
    name = codes.sanitize(F.col("line"))
    held = _bodies(snapshot.withColumn("name", name), ["name"], ["line", "id"], records.vehicle_record(False))
    every = lines.select(name.alias("name")).union(snapshot.select(name)).distinct()
    return every.join(held, "name", "left").select(F.concat(F.lit(f"{ROOT}/lines/"), "name", F.lit(".json")).alias("path"), F.coalesce("body", F.lit("[]")).alias("body"))


def cell_documents(snapshot: DataFrame, zoom: int) -> DataFrame:
    """The vehicles of every cell of the area, empty cells included."""
    held = _bodies(snapshot.withColumn("cx", geo.tile_x(F.col("lon"), zoom)).withColumn("cy", geo.tile_y(F.col("lat"), zoom)), ["cx", "cy"], ["line", "id"], records.vehicle_record(True))
    return _of_cells(snapshot.sparkSession, held, zoom, "vehicles")


def arrival_documents(arrivals: DataFrame, stops: DataFrame, zoom: int) -> DataFrame:
    """The arrivals at the stops of every cell (``stops``: stop_id, lat, lon), the nearest three of a line and direction a stop."""
    near = F.row_number().over(Window.partitionBy("stop_id", "line", "dir").orderBy("metres", "vehicle"))
    kept = arrivals.withColumn("place", near).where(F.col("place") <= PER_LINE)
    where = stops.groupBy("stop_id").agg(F.min(F.struct("lat", "lon")).alias("at")).select("stop_id", geo.tile_x(F.col("at.lon"), zoom).alias("cx"), geo.tile_y(F.col("at.lat"), zoom).alias("cy"))
    held = _bodies(kept.join(where, "stop_id"), ["cx", "cy"], ["stop_id", "metres", "vehicle", "line", "dir"], records.arrival_record())
    return _of_cells(arrivals.sparkSession, held, zoom, "arrivals")


def _of_cells(spark: SparkSession, held: DataFrame, zoom: int, name: str) -> DataFrame:
    path = F.concat(F.lit(f"{ROOT}/cells/{zoom}/"), "cx", F.lit("/"), "cy", F.lit(f"/{name}.json"))
    return cells(spark, zoom).join(held, ["cx", "cy"], "left").select(path.alias("path"), F.coalesce("body", F.lit("[]")).alias("body"))


def fleet_document(snapshot: DataFrame) -> DataFrame:
    """The whole fleet in one document, as a city's overview reads it: some thousand vehicles of 140 bytes."""
    body = F.array_sort(F.collect_list(F.struct("line", "id", records.vehicle_record(True).alias("record"))))
    one = snapshot.agg(body.alias("v"))
    return one.select(F.lit(f"{ROOT}/fleet.json").alias("path"), records.json_array(F.transform("v", lambda x: x["record"])).alias("body"))


def live_lines_document(snapshot: DataFrame, lines: DataFrame) -> DataFrame:
    """``[line, vehicles, known]`` of each line with a vehicle on the road, most first."""
    known = lines.select(codes.sanitize(F.col("line")).alias("name"), F.lit(1).alias("known")).distinct()
    n = snapshot.where(~F.col("phase").isin(*_IDLE)).groupBy("line").agg(F.count("*").alias("n"))
    rows = n.withColumn("name", codes.sanitize(F.col("line"))).join(known, "name", "left")
    item = F.concat(F.lit("["), records.json_string(F.col("line")), F.lit(","), "n", F.lit(","), F.coalesce("known", F.lit(0)), F.lit("]"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "line", item.alias("record")))).alias("v"))
    return one.select(F.lit(f"{ROOT}/live-lines.json").alias("path"), records.json_array(F.transform("v", lambda x: x["record"])).alias("body"))


def index_document(snapshot: DataFrame, arrivals: DataFrame, counts: DataFrame, reasons: DataFrame, now: int, zoom: int, version: str) -> DataFrame:
    """When and of what the cycle was made: counts (``key, n``), reasons (``reason, n``), cells, arrivals and vehicles a line."""
    pairs = lambda d, k: d.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n"))))).alias("j"))
    per_line = snapshot.groupBy("line").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "line", "n"))).alias("v"))
    lines = per_line.select(records.json_array(F.transform("v", lambda x: F.concat(F.lit("["), records.json_string(x["line"]), F.lit(","), x["n"], F.lit("]")))).alias("lines"))
    one = pairs(counts, "key").withColumnRenamed("j", "counts").join(pairs(reasons, "reason").withColumnRenamed("j", "reasons"))  # one row each
    one = one.join(arrivals.agg(F.count("*").alias("arrivals"))).join(lines)
    head = snapshot.sparkSession.range(1).select(records.json_string(F.lit(version)).alias("version")).join(cells(snapshot.sparkSession, zoom).agg(F.count("*").alias("cells")))
    body = F.concat(F.lit(f'{{"generated_at":{now},"feed_version":'), "version", F.lit(',"counts":'), "counts", F.lit(',"pending_reasons":'), "reasons", F.lit(f',"cells":{{"z":{zoom},"count":'), "cells", F.lit('},"arrivals":'), "arrivals", F.lit(',"lines":'), "lines", F.lit("}"))
    return one.join(head).select(F.lit(f"{ROOT}/index.json").alias("path"), body.alias("body"))
