"""Schedule preparation: representative trips, geometry, stop lists, speeds, headways and calendars from feed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import codes, folds, geo, times


def representative_trips(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """The trip of each shape with the most stop rows; of equals the last in the order of ``trip_id``."""
    counts = stop_times.groupBy("trip_id").agg(F.count("*").alias("n"))
    return trips.join(counts, "trip_id").groupBy("shape_id").agg(F.max(F.struct("n", "trip_id")).alias("m")).select("shape_id", F.col("m.trip_id").alias("trip_id"), F.col("m.n").alias("n"))


def geometry(points: DataFrame) -> DataFrame:
    """``shape_id, i, lat, lon, x, y, cum`` from shape points (shape_id, seq, lat, lon, fed): repeated sequence numbers are
    dropped, and the feed's distances are used if they never fall by over 0.5 m, end above 0 and within 5% of the computed length."""
    by = Window.partitionBy("shape_id").orderBy("seq")
    p = points.withColumn("__last", F.lag("seq").over(by)).where("__last is null or __last <> seq").drop("__last")
    p = p.withColumn("x", geo.x_of(F.col("lon"))).withColumn("y", geo.y_of(F.col("lat")))
    step = F.coalesce(geo.distance(F.lag("x").over(by), F.lag("y").over(by), F.col("x"), F.col("y")), F.lit(0.0))
    p = p.select("*", step.alias("step"), (F.col("fed") - F.lag("fed").over(by)).alias("rise"), (F.row_number().over(by) - 1).alias("i"))
    p = p.withColumn("own", F.sum("step").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("shape_id")
    known = F.bool_and(F.col("fed").isNotNull() & ~F.isnan("fed")).over(whole) & F.bool_and(F.coalesce(F.col("rise"), F.lit(0.0)) >= -0.5).over(whole)
    last, length = F.max("fed").over(whole), F.max("own").over(whole)
    p = p.withColumn("trusted", known & (last > 0) & (F.abs(last - length) <= 0.05 * length)).withColumn("points", F.count("*").over(whole))
    return p.where("points >= 2").select("shape_id", "i", "lat", "lon", "x", "y", F.when(F.col("trusted"), F.col("fed")).otherwise(F.col("own")).alias("cum"))


def shape_facts(geo_points: DataFrame) -> DataFrame:
    """Length, bounds, and whether a shape ends within 300 m of its start."""
    ends = [F.min_by(F.struct("x", "y"), "i").alias("a"), F.max_by(F.struct("x", "y"), "i").alias("b")]
    facts = geo_points.groupBy("shape_id").agg(F.max("cum").alias("length"), *ends, *(f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((0, F.min), (1, F.max))))
    return facts.withColumn("circular", geo.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) < 300).drop("a", "b")


def planned_speed(stop_rows: DataFrame) -> DataFrame:
    """Metres a second of each shape between its earliest and latest stop times; 6 where that says nothing."""
    e = stop_rows.where("at is not null").groupBy("shape_id").agg(F.min(F.struct("at", "ord", "dist")).alias("a"), F.max(F.struct("at", (-F.col("ord")).alias("o"), "dist")).alias("b"))
    dt, d = F.col("b.at") - F.col("a.at"), F.col("b.dist") - F.col("a.dist")
    return e.select("shape_id", F.when((dt > 60) & (d > 0), d / dt).otherwise(6.0).alias("planned"))


def hourly_rates(frequencies: DataFrame, order: list[str]) -> DataFrame:
    """Departures an hour of each key (line, svc) and hour of the day from windows (start, end, headway in seconds), each spread
    over the hours it touches by overlap; hours past midnight fold into the day.

    Rates are added in ``order``, which tells the windows of a key apart: a sum of doubles in whatever order a shuffle brings them
    may miss a half of a minute by its last bit. No part is negative, so the last running sum is the greatest.
    """
    f = frequencies.where("headway > 0 and end > start").repartition("line", "svc")
    h = f.withColumn("h", F.explode(F.sequence(F.expr("start div 3600"), F.expr("(end - 1) div 3600"))))
    overlap = F.least(F.col("end"), (F.col("h") + 1) * 3600) - F.greatest(F.col("start"), F.col("h") * 3600)
    parts = h.select("line", "svc", (F.col("h") % 24).cast("int").alias("hour"), "h", *order, (3600.0 / F.col("headway") * overlap / 3600.0).alias("part"))
    so_far = Window.partitionBy("line", "svc", "hour").orderBy(*order, "h").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("part", F.sum("part").over(so_far)).groupBy("line", "svc", "hour").agg(F.max("part").alias("rate"))


def headway_minutes(rate: Column) -> Column:
    return F.when(rate > 0.05, F.greatest(F.lit(1), F.round(60.0 / rate)).cast("int"))


def runs(hours: DataFrame) -> DataFrame:
    """Consecutive hours of one headway as runs: line, svc, from_hour, to_hour, minutes. Idle hours part runs."""
    w = Window.partitionBy("line", "svc", "minutes").orderBy("hour")
    island = hours.where("minutes is not null").withColumn("g", F.col("hour") - F.row_number().over(w))
    return island.groupBy("line", "svc", "minutes", "g").agg(F.min("hour").alias("from_hour"), (F.max("hour") + 1).alias("to_hour")).drop("g")


def weekday_services(calendar: DataFrame) -> DataFrame:
    """The least service code that runs on each weekday (0 Sunday to 6 Saturday)."""
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    days = F.filter(F.array(*(F.struct(F.lit(k).alias("weekday"), F.col(n).alias("runs")) for k, n in enumerate(names))), lambda d: d["runs"] == "1")
    c = calendar.withColumn("svc", times.service_code(F.col("service_id"))).where("svc is not null").withColumn("d", F.explode(days))
    return c.groupBy(F.col("d.weekday").alias("weekday")).agg(F.min("svc").alias("svc"))


def calendar_exceptions(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """``date, svc``: dates on which another service (null: none) runs than on their weekday. Added services win over regular ones."""
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    code = times.service_code(F.col("service_id"))
    d = dates.withColumn("svc", code).where("svc is not null").withColumn("day", F.try_to_date("date", "yyyyMMdd"))
    changes = d.groupBy("date", "day").agg(*(F.collect_set(F.when(F.col("exception_type") == k, F.col("svc"))).alias(n) for k, n in (("1", "added"), ("2", "removed"))))
    c = calendar.select(code.alias("svc"), "start_date", "end_date", F.array(*names).alias("week")).where("svc is not null")
    on = (F.get("week", F.dayofweek("day") - 1) == "1") & (F.col("start_date") <= F.col("date")) & (F.col("end_date") >= F.col("date"))
    running = changes.join(F.broadcast(c), on, "left").groupBy("date", "day").agg(F.first("added").alias("added"), F.first("removed").alias("removed"), F.collect_set("svc").alias("base"))
    left = F.array_except(F.array_union("base", "added"), "removed")
    svc = F.coalesce(F.array_min(F.array_intersect(left, F.col("added"))), F.array_min(left))
    usual = F.broadcast(weekday_services(calendar).withColumnRenamed("svc", "usual"))
    out = running.select("date", svc.alias("svc"), times.weekday(F.col("day")).alias("weekday")).join(usual, "weekday", "left")
    return out.where(~F.col("svc").eqNullSafe(F.col("usual"))).select("date", "svc")


def build(feed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The prepared tables of a feed: routes, shapes, points, stops, shape_stops, trips, headways, weekdays, exceptions."""
    num = lambda c: F.col(c).try_cast("double")
    routes = feed["routes"].select("route_id", F.col("route_short_name").alias("short_name"), F.col("route_long_name").alias("long_name"), F.coalesce(F.col("route_type").try_cast("int"), F.lit(3)).alias("route_type"), codes.hex_color(F.col("route_color")).alias("color"), codes.hex_color(F.col("route_text_color")).alias("text_color"))
    trips = feed["trips"].where("trip_id <> '' and shape_id <> ''").join(F.broadcast(routes.select("route_id")), "route_id")
    chosen = representative_trips(trips, feed["stop_times"])
    pts = feed["shapes"].join(F.broadcast(trips.select("shape_id").distinct()), "shape_id", "left_semi")
    pts = pts.select("shape_id", F.col("shape_pt_sequence").try_cast("int").alias("seq"), num("shape_pt_lat").alias("lat"), num("shape_pt_lon").alias("lon"), F.coalesce(num("shape_dist_traveled"), F.lit(float("nan"))).alias("fed"))
    points = geometry(pts.where("seq is not null and lat is not null and lon is not null"))
    facts = shape_facts(points)
    stops = feed["stops"].select("stop_id", codes.stop_name(F.col("stop_name")).alias("name"), codes.stop_note(F.col("stop_name")).alias("note"), num("stop_lat").alias("lat"), num("stop_lon").alias("lon")).where("lat is not null and lon is not null")
    rows = feed["stop_times"].join(F.broadcast(chosen.select("shape_id", "trip_id")), "trip_id").join(F.broadcast(stops.select("stop_id")), "stop_id")
    rows = rows.select("shape_id", "stop_id", F.col("stop_sequence").try_cast("int").alias("ord"), num("shape_dist_traveled").alias("dist"), times.schedule_seconds(F.col("arrival_time")).alias("at")).where("ord is not null and dist is not null")
    before = F.lag("dist").over(Window.partitionBy("shape_id").orderBy("dist", "ord", "stop_id"))
    held = rows.withColumn("__b", before).where("__b is null or dist - __b >= 1").drop("__b")
    about = trips.groupBy("shape_id").agg(F.min_by(F.struct("route_id", "direction_id"), "trip_id").alias("t"), F.min_by("trip_headsign", F.when(F.col("trip_headsign") != "", F.col("trip_id"))).alias("headsign"))
    shapes = about.select("shape_id", F.col("t.route_id").alias("route_id"), F.coalesce(F.col("t.direction_id").try_cast("int"), F.lit(0)).alias("direction"), F.coalesce("headsign", F.lit("")).alias("headsign")).join(facts, "shape_id").join(planned_speed(rows), "shape_id", "left").withColumn("planned", F.coalesce("planned", F.lit(6.0)))
    windows = feed["frequencies"].join(trips.select("trip_id", "shape_id", times.service_code(F.col("service_id")).alias("svc")), "trip_id").where("svc is not null")
    windows = windows.select(F.col("shape_id").alias("line"), "svc", "trip_id", times.schedule_seconds(F.col("start_time")).alias("start"), times.schedule_seconds(F.col("end_time")).alias("end"), F.col("headway_secs").try_cast("int").alias("headway"))
    headways = runs(hourly_rates(windows, ["trip_id", "start", "end", "headway"]).withColumn("minutes", headway_minutes(F.col("rate")))).withColumnRenamed("line", "shape_id")
    return {
        "routes": routes, "shapes": shapes, "points": points, "stops": stops, "shape_stops": held.select("shape_id", "stop_id", "ord", "dist"), "trips": trips.join(points.select("shape_id").distinct(), "shape_id", "left_semi").select("trip_id", "shape_id"),
        "headways": headways, "weekdays": weekday_services(feed["calendar"]), "exceptions": calendar_exceptions(feed["calendar"], feed["calendar_dates"]),
    }


FORMAT = 2


def save(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.withColumn("format_version", F.lit(FORMAT)).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Prepared tables; an older format is refused."""
    out = {}
    for n in names:
        df = spark.read.parquet(f"{path}/{n}")
        if (df.agg(F.min("format_version")).first()[0] or FORMAT) < FORMAT:
            raise ValueError("the prepared tables are of an older format: build them again")
        out[n] = df.drop("format_version")
    return out


def line_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """A JSON document for each line: its shapes with stops and their points as a polyline; named by the sanitised line."""
    stops = tables["shape_stops"].groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct(F.round("dist").cast("int").alias("at"), "stop_id"))).alias("stops"))
    path = tables["points"].groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("i", "lat", "lon"))).alias("p"))
    path = path.select("shape_id", folds.encode_polyline(F.flatten(F.transform("p", lambda q: F.array(q["lat"], q["lon"])))).alias("path"))
    shapes = tables["shapes"].join(stops, "shape_id", "left").join(path, "shape_id", "left").join(F.broadcast(tables["routes"]), "route_id")
    shape = F.struct("shape_id", "direction", "headsign", "circular", F.round("length").cast("int").alias("length"), "path", "stops")
    lines = shapes.groupBy("short_name", "long_name", "color").agg(F.array_sort(F.collect_list(F.struct("shape_id", shape.alias("s")))).alias("s"))
    return lines.select(codes.sanitize(F.col("short_name")).alias("name"), F.to_json(F.struct(F.col("short_name").alias("line"), "long_name", "color", F.col("s.s").alias("shapes"))).alias("body"))
