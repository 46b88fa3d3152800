"""The static documents that riders' screens load, from a prepared schedule: lines, headways, calendar, stops and what serves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vialens.functions import codes, folds, geo, records
from vialens.operators import documents, schedule


def _text(*columns: str) -> list[Column]:
    return [records.json_string(F.col(c)) for c in columns]


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def _document(rows: DataFrame, path: str, order: list[str], item: Column, opening: str = "[", closing: str = "]") -> DataFrame:
    """One document of all rows in order: a city's lines or stops, some thousand."""
    one = rows.agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))).alias("v"))
    return one.select(F.lit(path).alias("path"), F.concat(F.lit(opening), F.array_join(F.transform("v", lambda v: v["item"]), ","), F.lit(closing)).alias("body"))


def _degrees(c: str) -> Column:
    return (F.round(F.col(c) * 1e5) / 1e5).cast("string")


def stop_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """``stop_id, lines``: the lines that serve each stop, sorted, each once."""
    of = tables["shapes"].select("shape_id", "route_id").join(tables["routes"].select("route_id", "short_name"), "route_id")
    return tables["shape_stops"].join(of, "shape_id").groupBy("stop_id").agg(F.array_sort(F.collect_set("short_name")).alias("lines"))


def line_headways(tables: dict[str, DataFrame]) -> DataFrame:
    """``line, svc, from_hour, to_hour, minutes``: the least headway over a line's shapes, as runs of hours."""
    of = tables["shapes"].select("shape_id", "route_id").join(tables["routes"].select("route_id", F.col("short_name").alias("line")), "route_id")
    hours = tables["headways"].join(of, "shape_id").withColumn("hour", F.explode(F.sequence(F.col("from_hour"), F.col("to_hour") - 1))).where("hour < 24")
    return schedule.runs(hours.groupBy("line", "svc", "hour").agg(F.min("minutes").alias("minutes")))


def line_bundles(tables: dict[str, DataFrame]) -> DataFrame:
    """``lines/<name>.json`` for each line: its shapes with path, stops, headways and planned speed."""
    at = tables["shape_stops"].join(tables["stops"], "stop_id")
    stop = _list(records.json_string(F.col("stop_id")), _degrees("lat"), _degrees("lon"), records.json_string(F.col("name")), F.round("dist").cast("long").cast("string"), records.json_string(F.col("note")))
    stops = at.groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("dist", "ord", stop.alias("item")))).alias("stops"))
    path = tables["points"].groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("p"))
    path = path.select("shape_id", folds.encode_polyline(F.flatten(F.transform("p", lambda q: F.array(q["lat"], q["lon"])))).alias("poly"))
    run = _list(*(F.col(c).cast("string") for c in ("svc", "from_hour", "to_hour", "minutes")))
    freq = tables["headways"].groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("svc", "from_hour", run.alias("item")))).alias("freq"))
    shapes = tables["shapes"].join(path, "shape_id").join(stops, "shape_id", "left").join(freq, "shape_id", "left")
    pairs = {"shape": records.json_string(F.col("shape_id")), "dir": F.col("direction").cast("string"), "circular": F.col("circular").cast("string"), "headsign": records.json_string(F.col("headsign")), "len": F.round("length").cast("long").cast("string")}
    pairs |= {"planned": F.round("planned", 1).cast("string"), "freq": records.json_array(F.transform("freq", lambda r: r["item"])), "poly": records.json_string(F.col("poly")), "stops": records.json_array(F.transform("stops", lambda s: s["item"]))}
    entry = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in pairs.items())), F.lit("}"))
    dirs = shapes.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("direction", "shape_id", entry.alias("item")))).alias("dirs"))
    lines = tables["routes"].join(dirs, "route_id", "left")
    head = {"line": records.json_string(F.col("short_name")), "name": records.json_string(F.col("long_name")), "type": F.col("route_type").cast("string"), "color": records.json_string(F.col("color")), "text": records.json_string(F.col("text_color"))}
    body = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in head.items())), F.lit(',"dirs":'), records.json_array(F.transform("dirs", lambda d: d["item"])), F.lit("}"))
    each = lines.select(F.concat(F.lit("lines/"), codes.sanitize(F.col("short_name")), F.lit(".json")).alias("path"), "route_id", body.alias("body"))
    return each.groupBy("path").agg(F.max_by("body", "route_id").alias("body"))  # names that become one file: the last route's


def directory_documents(tables: dict[str, DataFrame], aliases: DataFrame | None = None) -> DataFrame:
    """``lines.json, freq.json, calendar.json, stops.json`` and ``stop-lines.json``. ``aliases``: ``short_name, aka`` (sorted array)."""
    ends = tables["shapes"].where("headsign <> ''").groupBy("route_id").agg(F.array_sort(F.collect_set("headsign")).alias("ends"))
    lines = tables["routes"].join(ends, "route_id", "left")
    lines = lines.withColumn("aka", F.expr("cast(array() as array<string>)")) if aliases is None else lines.join(aliases, "short_name", "left")
    words = lambda c: F.coalesce(F.to_json(F.col(c)), F.lit("[]"))
    catalog = _document(lines, "lines.json", ["short_name", "long_name"], _list(*_text("short_name", "long_name"), F.col("route_type").cast("string"), words("ends"), words("aka"), *_text("color", "text_color")))
    run = _list(*(F.col(c).cast("string") for c in ("svc", "from_hour", "to_hour", "minutes")))
    freq = line_headways(tables).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("svc", "from_hour", run.alias("item")))).alias("r"))
    freq = _document(freq, "freq.json", ["line"], F.concat(records.json_string(F.col("line")), F.lit(":"), records.json_array(F.transform("r", lambda r: r["item"]))), "{", "}")
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.coalesce(F.get(F.transform(F.filter("w", lambda x: x["weekday"] == d), lambda x: x["svc"]), F.lit(0)).cast("string"), F.lit("null")))
    week = tables["weekdays"].agg(F.collect_list(F.struct("weekday", "svc")).alias("w")).select(records.json_array(days).alias("weekdays"))
    other = _document(tables["exceptions"], "calendar.json", ["date"], F.concat(records.json_string(F.col("date")), F.lit(":"), F.coalesce(F.col("svc").cast("string"), F.lit("null"))), "{", "}")
    calendar = other.join(week).select("path", F.concat(F.lit('{"weekdays":'), "weekdays", F.lit(',"exceptions":'), "body", F.lit("}")).alias("body"))  # one row each
    stops = _document(tables["stops"], "stops.json", ["stop_id"], _list(*_text("stop_id"), _degrees("lat"), _degrees("lon"), *_text("name", "note")))
    served = _document(stop_lines(tables), "stop-lines.json", ["stop_id"], F.concat(records.json_string(F.col("stop_id")), F.lit(":"), F.to_json("lines")), "{", "}")
    return catalog.union(freq).union(calendar).union(stops).union(served)


def stop_cells(tables: dict[str, DataFrame], zoom: int) -> DataFrame:
    """``cells/<zoom>/<x>/<y>/stops.json``: the stops that a line serves in each map cell of the area, empty cells included."""
    rows = tables["stops"].join(stop_lines(tables), "stop_id")
    item = _list(*_text("stop_id"), _degrees("lat"), _degrees("lon"), *_text("name", "note"), F.to_json("lines"))
    held = rows.groupBy(geo.tile_x(F.col("lon"), zoom).alias("cx"), geo.tile_y(F.col("lat"), zoom).alias("cy")).agg(F.array_sort(F.collect_list(F.struct("stop_id", item.alias("item")))).alias("v"))
    every = documents.cells(rows.sparkSession, zoom).join(held, ["cx", "cy"], "left")
    return every.select(F.concat_ws("/", F.lit(f"cells/{zoom}"), "cx", "cy", F.lit("stops.json")).alias("path"), records.json_array(F.transform("v", lambda v: v["item"])).alias("body"))


def static_documents(tables: dict[str, DataFrame], zoom: int = 13, aliases: DataFrame | None = None) -> DataFrame:
    """All static documents (``path, body``), for ``files.write_documents``, which also deletes those of lines renamed since."""
    return line_bundles(tables).union(directory_documents(tables, aliases)).union(stop_cells(tables, zoom))
