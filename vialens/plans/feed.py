"""Queries on a whole schedule feed made of the driver's tables: nations are routes, orders trips, customers shapes, suppliers stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.operators import bundles, schedule
from vialens.plans.registry import ORACLES, query, table
from vialens.plans.schedule import _calendar, _dates

FREQUENCIES = [("1", "06:00:00", "09:00:00", "300"), ("2", "09:00:00", "25:00:00", "600")]
TRIPS_SQL = """tr as (select cast(o_orderkey as varchar) as trip_id, c_nationkey as route, concat('c', o_custkey) as shape_id, o_custkey from orders join customer on c_custkey = o_custkey),
st as (select cast(l_orderkey as varchar) as trip_id, concat('s', l_suppkey) as stop_id, l_linenumber as ord, floor(l_quantity) / 2 as dist from lineitem),
best as (select shape_id, trip_id, n from (select shape_id, trip_id, count(*) as n from tr join st using (trip_id) group by all) qualify row_number() over (partition by shape_id order by n desc, trip_id desc) = 1),
kept as (select shape_id, trip_id, dist from (select *, lag(dist) over (partition by shape_id order by dist, ord, stop_id) as before from best join st using (trip_id)) where before is null or dist - before >= 1)"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The feed's files as tables of text."""
    read = lambda n: table(spark, sf_dir, n)
    text = lambda *cols: [F.concat(F.lit(p), F.col(c)).alias(a) for p, c, a in cols]
    routes = read("nation").select(*text(("", "n_nationkey", "route_id"), ("", "n_name", "route_short_name"), ("Line ", "n_name", "route_long_name")), F.lit("3").alias("route_type"), F.lit("0000ff").alias("route_color"), F.lit("").alias("route_text_color"))
    home = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    trips = read("orders").join(home, "o_custkey").select(*text(("", "o_orderkey", "trip_id"), ("", "c_nationkey", "route_id"), ("c", "o_custkey", "shape_id")), (F.col("o_custkey") % 2).cast("string").alias("direction_id"), F.lit("").alias("trip_headsign"), F.lit("U_REG").alias("service_id"))
    shapes = read("customer").withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 4 + 1).cast("int"))))
    shapes = shapes.select(*text(("c", "c_custkey", "shape_id"), ("", "i", "shape_pt_sequence")), F.lit("-22.9").alias("shape_pt_lat"), (F.col("i") * 0.01 - 43.4).cast("string").alias("shape_pt_lon"), F.lit("").alias("shape_dist_traveled"))
    stops = read("supplier").select(*text(("s", "s_suppkey", "stop_id"), ("", "s_name", "stop_name")), (F.col("s_suppkey") / 100000 - 22.9).cast("string").alias("stop_lat"), F.lit("-43.4").alias("stop_lon"))
    held = F.concat(F.lpad(F.floor(F.col("l_quantity")).cast("string"), 2, "0"), F.lit(":00:00"))
    stop_times = read("lineitem").select(*text(("", "l_orderkey", "trip_id"), ("s", "l_suppkey", "stop_id"), ("", "l_linenumber", "stop_sequence")), (F.floor("l_quantity") / 2).cast("string").alias("shape_dist_traveled"), held.alias("arrival_time"))
    frequencies = spark.createDataFrame(FREQUENCIES, "trip_id string, start_time string, end_time string, headway_secs string")
    return {"routes": routes, "trips": trips, "shapes": shapes, "stops": stops, "stop_times": stop_times, "frequencies": frequencies, "calendar": _calendar(spark), "calendar_dates": _dates(spark, sf_dir)}


@query("with " + TRIPS_SQL + " select shape_id, route, count(*) as trips from tr group by all")
def gtfs_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trips of each prepared shape that has a geometry, and its route."""
    built = schedule.build(tables(spark, sf_dir))
    trips = built["trips"].groupBy("shape_id").agg(F.count("*").alias("trips"))
    home = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("shape_id"), F.col("c_nationkey").alias("route"))
    return trips.join(home, "shape_id").select("shape_id", "route", "trips")


@query("with " + TRIPS_SQL + " select shape_id, count(*) as stops, min(dist) as first_at, max(dist) as last_at, sum(dist) as total from kept group by shape_id")
def gtfs_stop_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop list of each shape, from its trip with the most stops, without those under a metre from the one before."""
    rows = schedule.build(tables(spark, sf_dir))["shape_stops"]
    return rows.groupBy("shape_id").agg(F.count("*").alias("stops"), F.min("dist").alias("first_at"), F.max("dist").alias("last_at"), F.sum("dist").alias("total"))


@query("with " + TRIPS_SQL + """, sh as (select distinct shape_id, o_custkey from tr) select (select count(*) from nation) as routes, (select count(*) from sh where shape_id in (select shape_id from best)) as shapes, (select cast(sum(o_custkey % 4 + 2) as bigint) from sh) as points,
  (select count(*) from supplier) as stops, (select count(*) from tr) as trips, (select count(*) from kept) as links""")
def feed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many routes, shapes, points, stops, trips and shape-stop links the prepared feed has."""
    built = schedule.build(tables(spark, sf_dir))
    shapes = built["shapes"].join(built["shape_stops"].select("shape_id"), "shape_id", "left_semi")
    counts = [("routes", built["routes"]), ("shapes", shapes), ("points", built["points"]), ("stops", built["stops"]), ("trips", built["trips"]), ("links", built["shape_stops"])]
    one = None
    for name, df in counts:
        n = df.agg(F.count("*").alias(name))
        one = n if one is None else one.join(F.broadcast(n))  # one row each
    return one


@query("with " + TRIPS_SQL + """, sh as (select shape_id, min(route) as route from tr where shape_id in (select shape_id from best) group by shape_id),
  held as (select distinct stop_id, n_name from (select *, lag(dist) over (partition by shape_id order by dist, ord, stop_id) as before from best join st using (trip_id)) join sh using (shape_id) join nation on n_nationkey = route where before is null or dist - before >= 1),
  w as (select trip_id, hour, minutes from (values ('1', [6, 7, 8], 5), ('2', [9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 0], 10)) f(trip_id, hours, minutes), unnest(hours) h(hour)),
  b as (select n_name as line, hour, min(minutes) as minutes from w join tr using (trip_id) join nation on n_nationkey = route where tr.shape_id in (select shape_id from sh) group by all),
  r as (select line, minutes, min(hour) as a, max(hour) + 1 as z from (select *, hour - row_number() over (partition by line, minutes order by hour) as g from b) group by line, minutes, g),
  fq as (select line, '[' || string_agg('[0,' || a || ',' || z || ',' || minutes || ']', ',' order by a) || ']' as runs from r group by line),
  sl as (select stop_id, string_agg('"' || n_name || '"', ',' order by n_name) as lines from held group by stop_id),
  x as (select date, svc from (""" + ORACLES["calendar_exceptions"] + """))
  select 'lines.json' as path, '[' || string_agg('["' || n_name || '","Line ' || n_name || '",3,[],[],"#0000FF",""]', ',' order by n_name) || ']' as body from nation
  union all select 'freq.json', '{' || coalesce(string_agg('"' || line || '":' || runs, ',' order by line), '') || '}' from fq
  union all select 'calendar.json', '{"weekdays":[2,0,0,0,0,0,1],"exceptions":{' || string_agg('"' || date || '":' || coalesce(svc::varchar, 'null'), ',' order by date) || '}}' from x
  union all select 'stops.json', '[' || string_agg('["s' || s_suppkey || '",' || round(cast(s_suppkey as double) / 100000 - 22.9::double, 5) || ',-43.4,"' || s_name || '",""]', ',' order by 's' || s_suppkey) || ']' from supplier
  union all select 'stop-lines.json', '{' || string_agg('"' || stop_id || '":[' || lines || ']', ',' order by stop_id) || '}' from sl""")
def directory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of a prepared schedule: its lines, their headways, the calendar, the stops and which lines serve each."""
    return bundles.directory_documents(schedule.build(tables(spark, sf_dir)))
