"""Queries of a rider's screen and of the bundles that it reads: times, boards, stops by tile, the index document."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.constants import AREA_LAT, AREA_LON, MAX_SPEED_MS, OFF_ROUTE_S, TENTATIVE_M
from vialens.functions import geo, records
from vialens.operators import lookups, schedule, spatial
from vialens.plans import fixture
from vialens.plans.fixture import FX, LATEST_SQL, ROUTES_SQL, SHAPES_SQL
from vialens.plans.fleet import ON_ROAD, RESOLVED_SQL, on_road
from vialens.plans.registry import ORACLES, query, table
from vialens.plans.schedule import RATES_SQL, hourly_rates
from vialens.plans.spatial import ahead_rows

GOOD = LATEST_SQL.split("latest as")[0].rstrip().rstrip(",")
ZOOM = 13
#: Arrivals with what their vehicle and shape say, in DuckDB.
AHEAD_SQL = "with recursive a as (" + ORACLES["arrivals_ahead"] + "), l as (" + ON_ROAD + """ select vehicle, t, line from resolved),
  ar as (select a.*, l.t, l.line, 'to ' || right(shape_id, 1) as headsign, case when right(shape_id, 1) = '1' then 'volta' else 'ida' end as dir from a join l using (vehicle))"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ahead_rows(spark, sf_dir)
    return rows.select("*", F.concat(F.lit("to "), "direction").alias("headsign"), F.when(F.col("direction") == 1, "volta").otherwise("ida").alias("dir"))


@query("""with e as (select event_id, cast(event_id * 37 % 9000 - 100 as double) as ahead, cast(event_id % 17 - 1 as double) as own, case when event_id % 3 > 0 then cast(event_id % 13 as double) end as line from events),
  v as (select *, greatest(ahead, 0) as m, exp(-greatest(ahead, 0) / 1500.0) as w, least(greatest(coalesce(line, 6.0), 8 / 3.6), 40 / 3.6) as base from e),
  c as (select *, m / least(greatest(w * greatest(own, 0) + (1 - w) * base, 8 / 3.6), 40 / 3.6) as c from v) select event_id, round(0.7 * c, 4) as eta_lo, round(1.4 * c + 30, 4) as eta_hi from c""")
def eta_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of seconds to a place ahead, from the vehicle's own speed and its line's, 6 m/s if that is unknown."""
    k = F.col("event_id")
    lo, hi = geo.eta_bounds((k * 37 % 9000 - 100).cast("double"), (k % 17 - 1).cast("double"), F.when(k % 3 > 0, (k % 13).cast("double")), F.lit(6.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(lo, 4).alias("eta_lo"), F.round(hi, 4).alias("eta_hi"))


@query(AHEAD_SQL + """, n as (select max(t) as now from l), e as (select stop_id, shape_id, vehicle, metres, greatest(0, eta_lo - (now - t)) / 60 as lo, greatest(0, eta_hi - (now - t)) / 60 as hi from ar, n)
  select stop_id, shape_id, vehicle, case when metres <= 150 or hi <= 1.2 then 'arriving' else concat(greatest(1, cast(floor(lo) as bigint)), '-', greatest(greatest(1, cast(floor(lo) as bigint)) + 1, cast(ceil(hi) as bigint))) end as minutes from e""")
def eta_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a board shows of an arrival: the whole minutes from now on, less those since the vehicle reported."""
    rows = _arrivals(spark, sf_dir)
    now = fixture.latest(fixture.fixes(spark, sf_dir)).agg(F.max("t").alias("now"))
    rows = rows.join(F.broadcast(now))
    left = lambda c: F.greatest(F.lit(0.0), F.col(c) - (F.col("now") - F.col("t"))) / 60
    lo, hi = F.greatest(F.lit(1), F.floor(left("eta_lo"))), F.ceil(left("eta_hi"))
    text = F.when((F.col("metres") <= 150) | (left("eta_hi") <= 1.2), "arriving").otherwise(F.concat_ws("-", lo, F.greatest(lo + 1, hi)))
    return rows.select("stop_id", "shape_id", "vehicle", text.alias("minutes"))


@query(AHEAD_SQL + " select stop_id, coalesce(line, '') as line, headsign, count(*) as n, string_agg(vehicle, ',' order by (eta_lo + eta_hi) / 2, vehicle) as vehicles from ar group by all")
def arrivals_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals of each stop by line and headsign, soonest first; a stop's arrivals of one line are some ten."""
    item = F.struct(((F.col("eta_lo") + F.col("eta_hi")) / 2).alias("at"), "vehicle")
    rows = _arrivals(spark, sf_dir).groupBy("stop_id", F.coalesce("line", F.lit("")).alias("line"), "headsign").agg(F.array_sort(F.collect_list(item)).alias("a"))
    return rows.select("stop_id", "line", "headsign", F.size("a").cast("long").alias("n"), F.array_join(F.col("a.vehicle"), ",").alias("vehicles"))


@query(AHEAD_SQL + """, j as (select stop_id, metres, shape_id, vehicle, '["' || stop_id || '","' || line || '","' || headsign || '","' || dir || '",' || stops_away || ',' || cast(round(metres) as bigint) || ',' || t || ',"' || vehicle || '",' || cast(round(eta_lo) as bigint) || ',' || cast(round(eta_hi) as bigint) || ']' as item from ar)
  select stop_id, '[' || string_agg(item, ',' order by metres, shape_id, vehicle) || ']' as body from j group by stop_id""")
def arrival_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals of each stop as JSON arrays of ten: stop, line, headsign, direction, stops away, metres, time, vehicle, least and most seconds."""
    whole = lambda c: F.round(c).cast("long").cast("string")
    quoted = lambda c: records.json_string(F.col(c))
    item = F.concat_ws(",", *map(quoted, ("stop_id", "line", "headsign", "dir")), F.col("stops_away").cast("string"), whole("metres"), F.col("t").cast("string"), quoted("vehicle"), whole("eta_lo"), whole("eta_hi"))
    rows = _arrivals(spark, sf_dir).groupBy("stop_id").agg(F.array_sort(F.collect_list(F.struct("metres", "shape_id", "vehicle", F.concat(F.lit("["), item, F.lit("]")).alias("item")))).alias("a"))
    return rows.select("stop_id", F.concat(F.lit("["), F.array_join(F.col("a.item"), ","), F.lit("]")).alias("body"))


@query(AHEAD_SQL + "," + SHAPES_SQL.strip() + """, mine as (select shape_id, stop_id from stp qualify row_number() over (partition by route_ix order by round(sqrt(power(x - 6100, 2) + power(y - 700, 2)), 3), direction, ord) = 1),
  c as (select ar.*, row_number() over (partition by ar.shape_id order by (eta_lo + eta_hi) / 2, vehicle) as place from ar join mine using (shape_id, stop_id))
  select line, stop_id, cast(place as int) as place, vehicle, t, stops_away, metres from c where place <= 3""")
def coming_to_my_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line, the three next vehicles to the stop that one would walk to, each as the fleet has it."""
    stops = fixture.stops(spark).select("route_ix", "shape_id", "stop_id", "direction", "ord", F.round(geo.distance(F.col("x"), F.col("y"), F.lit(6100.0), F.lit(700.0)), 3).alias("m"))
    mine = stops.groupBy("route_ix").agg(F.min(F.struct("m", "direction", "ord", "shape_id", "stop_id")).alias("s")).select("s.shape_id", "s.stop_id")
    place = F.row_number().over(Window.partitionBy("shape_id").orderBy((F.col("eta_lo") + F.col("eta_hi")) / 2, "vehicle"))
    rows = _arrivals(spark, sf_dir).join(mine, ["shape_id", "stop_id"]).withColumn("place", place)
    return rows.where("place <= 3").select("line", "stop_id", "place", "vehicle", "t", "stops_away", "metres")


SPEEDS_SQL = """m as (select vehicle, service, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) / (t - lag(t) over w) as v from good window w as (partition by vehicle order by t, event_id)),
  lv as (select vehicle, round(avg(v), 3) as v from m where v <= 27 group by vehicle), sp as (select line, list_sort(list(v))[count(*) // 2 + 1] as line_speed from resolved join lv using (vehicle) where line is not null group by line having count(*) >= 3)"""


@query("with recursive a as (" + ORACLES["arrivals_ahead"] + "), k as (" + ON_ROAD + "," + SPEEDS_SQL + """ select vehicle, resolved.line, line_speed, lv.v as own from resolved left join lv using (vehicle) left join sp on sp.line = resolved.line)
  select stop_id, shape_id, vehicle, line_speed, round(0.7 * greatest(metres, 0) / s, 5) as eta_lo, round(1.4 * greatest(metres, 0) / s + 30, 5) as eta_hi
  from (select *, least(greatest(exp(-greatest(metres, 0) / 1500.0) * greatest(coalesce(own, 0), 0) + (1 - exp(-greatest(metres, 0) / 1500.0)) * least(greatest(coalesce(line_speed, 6.0), 8 / 3.6), 40 / 3.6), 8 / 3.6), 40 / 3.6) as s from a join k using (vehicle))""")
def arrivals_with_line_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals by each vehicle's own mean speed and the upper median of its line's, where three vehicles give one."""
    w = Window.partitionBy("vehicle").orderBy("t", "event_id")
    step = geo.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y"))
    moved = fixture.good_fixes(fixture.fixes(spark, sf_dir)).select("vehicle", F.try_divide(step, F.col("t") - F.lag("t").over(w)).alias("v")).where(F.col("v") <= MAX_SPEED_MS)
    own = moved.groupBy("vehicle").agg(F.round(F.avg("v"), 3).alias("own"))
    lines = on_road(spark, sf_dir).where("line is not null").select("vehicle", "line").join(own, "vehicle")
    speed = lines.groupBy("line").agg(F.array_sort(F.collect_list("own")).alias("v")).where(F.size("v") >= 3).select("line", F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("line_speed"))
    rows = _arrivals(spark, sf_dir).join(own, "vehicle", "left").join(speed, "line", "left")
    lo, hi = geo.eta_bounds(F.col("metres"), F.coalesce("own", F.lit(0.0)), F.col("line_speed"), F.lit(6.0))
    return rows.select("stop_id", "shape_id", "vehicle", "line_speed", F.round(lo, 5).alias("eta_lo"), F.round(hi, 5).alias("eta_hi"))


@query("with recursive a as (" + ORACLES["arrivals_ahead"] + "), k as (" + ON_ROAD + """ select vehicle, line, t, lat, lon, heading, y, route_ix from resolved),
  n as (select vehicle, shape_id, first(stop_id order by stops_away) as next_stop from a group by all)
  select vehicle, line, t, round(lat, 5) as lat, round(lon, 5) as lon, cast(round(heading) as int) as bearing, case when right(shape_id, 1) = '1' then 'volta' else 'ida' end as dir, next_stop, cast(case when abs(y - route_ix * 1500) <= 60 then 0.95 else 0.7 end as double) as conf from n join k using (vehicle)""")
def vehicle_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vehicle on a route, for both of its shapes: line, place, direction's name, the next stop and how sure the place is."""
    following = _arrivals(spark, sf_dir).groupBy("vehicle", "direction", "dir").agg(F.min_by("stop_id", "stops_away").alias("next_stop"))
    rows = on_road(spark, sf_dir).join(following, "vehicle")
    sure = F.when(F.abs(F.col("y") - F.col("route_ix") * 1500) <= 60, 0.95).otherwise(0.7)
    return rows.select("vehicle", "line", "t", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), F.round("heading").cast("int").alias("bearing"), "dir", "next_stop", sure.alias("conf"))


@query(FX + ", " + ROUTES_SQL + "," + GOOD + "," + RESOLVED_SQL.format(src="good") + """, d as (select vehicle, t, event_id, sqrt(power(y - route_ix * 1500, 2) + power(greatest(-x, x - 12000, 0), 2)) > 200 as off from resolved where route_ix is not null),
  g as (select *, sum(case when off then 0 else 1 end) over (partition by vehicle order by t, event_id rows unbounded preceding) as run from d), s as (select *, min(t) filter (where off) over (partition by vehicle, run) as since from g)
  select vehicle, count(*) as n, count(*) filter (where off) as off_route, count(*) filter (where off and t - since > 600) as fired, max(case when off then t - since else 0 end) as longest from s group by vehicle""")
def off_route_timer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes off their route (200 m), and those after over 600 s off it; a fix on the route starts the clock anew.

    Windows, not a fold: the clock runs over a vehicle's whole history and no array of it is built."""
    rows = lookups.resolve_service(fixture.good_fixes(fixture.fixes(spark, sf_dir)), fixture.routes(spark), fixture.aliases(spark)).where("route_ix is not null")
    away = F.hypot(F.col("y") - F.col("route_ix") * 1500, F.greatest(-F.col("x"), F.col("x") - 12000, F.lit(0.0)))
    rows = rows.select("vehicle", "t", "event_id", (away > TENTATIVE_M).alias("off"))
    w = Window.partitionBy("vehicle").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    back = F.last(F.when(~F.col("off"), F.struct("t", "event_id")), ignorenulls=True).over(w)
    rows = rows.withColumn("run", back)
    since = F.min(F.when(F.col("off"), F.col("t"))).over(Window.partitionBy("vehicle", "run").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("since", since)
    lasting = F.when(F.col("off"), F.col("t") - F.col("since")).otherwise(0)
    return rows.groupBy("vehicle").agg(F.count("*").alias("n"), F.count_if("off").alias("off_route"), F.count_if(lasting > OFF_ROUTE_S).alias("fired"), F.max(lasting).alias("longest"))


@query("with recursive e as (select event_id, cast(greatest(0, least(12000, event_id * 53 % 12300 - 100)) as double) as along, event_id % 6 as s from events), c as (select event_id, s, greatest(along - 15, 0) as a, least(along + 15, 12000) as b from e)"
  " select event_id, concat('s', s // 2, '_', s % 2) as shape_id, case when s % 2 = 0 then 90.0 else 270.0 end as bearing, b - a as chord from c")  # fmt: skip
def shape_bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bearing of a shape at a distance along it: that of the chord 15 m to either side, its ends found by equi joins on segments."""
    k = F.col("event_id")
    along = F.greatest(F.lit(0), F.least(F.lit(12000), k * 53 % 12300 - 100)).cast("double")
    at = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("s"), F.floor(k % 6 / 2), F.lit("_"), k % 2).alias("shape_id"), F.greatest(along - 15, F.lit(0.0)).alias("a"), F.least(along + 15, F.lit(12000.0)).alias("b"))
    segs = spatial.segments(fixture.points(spark), ["shape_id"]).select("shape_id", "seg", "ax", "ay", "bx", "by", "cum0", "cum1")
    for end in ("a", "b"):
        share = (F.col(end) - F.col("cum0")) / (F.col("cum1") - F.col("cum0"))
        at = at.withColumn("seg", F.least(F.lit(239), F.floor(F.col(end) / 50)).cast("int")).join(F.broadcast(segs), ["shape_id", "seg"])
        at = at.withColumns({f"{end}_x": F.col("ax") + share * (F.col("bx") - F.col("ax")), f"{end}_y": F.col("ay") + share * (F.col("by") - F.col("ay"))}).drop("seg", "ax", "ay", "bx", "by", "cum0", "cum1")
    return at.select("event_id", "shape_id", F.round(geo.bearing(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y")), 6).alias("bearing"), (F.col("b") - F.col("a")).alias("chord"))


@query(RATES_SQL + """, q as (select concat('c', user_id) as line, cast(case dayofweek(ts) when 0 then 2 when 6 then 1 else 0 end as int) as svc, cast(hour(ts) as int) as hour, count(*) as n from events group by all)
  select line, svc, hour, n, (select min(minutes) from runs r where r.line = q.line and r.svc = q.svc and hour >= from_hour and hour < to_hour) as headway, (select min(from_hour) from runs r where r.line = q.line and r.svc = q.svc and from_hour > hour) as starts from q""")
def headway_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scheduled headway of a line at a moment, and the hour in which its next run starts; by line, day type and hour asked for."""
    line = F.concat(F.lit("c"), "user_id")
    day = F.dayofweek("ts")
    asked = table(spark, sf_dir, "events").groupBy(line.alias("line"), F.when(day == 1, 2).when(day == 7, 1).otherwise(0).alias("svc"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    runs = schedule.runs(hourly_rates(spark, sf_dir).withColumn("minutes", schedule.headway_minutes(F.col("rate"))))
    held = runs.groupBy("line", "svc").agg(F.array_sort(F.collect_list(F.struct("from_hour", "to_hour", "minutes"))).alias("r"))  # 24 runs at most
    rows = asked.join(held, ["line", "svc"], "left")
    now = F.filter("r", lambda r: (F.col("hour") >= r["from_hour"]) & (F.col("hour") < r["to_hour"]))
    later = F.filter("r", lambda r: r["from_hour"] > F.col("hour"))
    return rows.select("line", "svc", "hour", "n", F.get(now, F.lit(0))["minutes"].alias("headway"), F.get(later, F.lit(0))["from_hour"].alias("starts"))


@query(ON_ROAD + " select short_name as line, true as scheduled from routes union select service, false from resolved where route_ix is null")
def catalog_with_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's codes and those on the road that no route has."""
    codes = fixture.routes(spark).select(F.col("short_name").alias("line"), F.lit(True).alias("scheduled"))
    return codes.union(on_road(spark, sf_dir).where("route_ix is null").select("service", F.lit(False))).distinct()


def _rows_of_tiles() -> tuple[int, int, int, int]:
    """First and last tile columns and rows of the served area."""
    n = 1 << ZOOM
    column = lambda lon: int((lon + 180.0) / 360.0 * n)
    row = lambda lat: int((1.0 - math.log(math.tan(math.radians(lat)) + 1.0 / math.cos(math.radians(lat))) / math.pi) / 2.0 * n)
    return column(AREA_LON[0]), column(AREA_LON[1]), row(AREA_LAT[1]), row(AREA_LAT[0])


X0, X1, Y0, Y1 = _rows_of_tiles()
TILE_SQL = "cast(floor((lon + 180) / 360 * 8192) as int) as tile_x, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192) as int) as tile_y"
STOPS_SQL = "p as (select concat('s', s_suppkey) as stop_id, -43.45 + (s_suppkey * 13 % 400) * 0.0005 as lon, -22.95 + (s_suppkey * 7 % 240) * 0.0005 as lat, n_name as lines from supplier join nation on n_nationkey = s_nationkey), s as (select *, " + TILE_SQL + " from p)"


def stops_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stops, each with the line of its nation."""
    lat, lon = -22.95 + (F.col("s_suppkey") * 7 % 240) * 0.0005, -43.45 + (F.col("s_suppkey") * 13 % 400) * 0.0005
    lines = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("lines"))
    rows = table(spark, sf_dir, "supplier").join(lines, "s_nationkey").select(F.concat(F.lit("s"), "s_suppkey").alias("stop_id"), "lines", lat.alias("lat"), lon.alias("lon"))
    return rows.withColumns({"tile_x": geo.tile_x(F.col("lon"), ZOOM), "tile_y": geo.tile_y(F.col("lat"), ZOOM)})


@query("with " + STOPS_SQL + f""", tiles as (select cast(a as int) as tile_x, cast(b as int) as tile_y from range({X0}, {X1} + 1) x(a), range({Y0}, {Y1} + 1) y(b))
  select tile_x, tile_y, count(stop_id) as n, coalesce('[' || string_agg(stop_id || ' ' || lines, '; ' order by stop_id) || ']', '[]') as body from tiles left join s using (tile_x, tile_y) group by all""")
def stops_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops that a line serves by map tile, for every tile of the served area."""
    tiles = spark.range(X0, X1 + 1).select(F.col("id").cast("int").alias("tile_x"), F.explode(F.sequence(F.lit(Y0), F.lit(Y1))).alias("tile_y"))
    held = stops_with_lines(spark, sf_dir).groupBy("tile_x", "tile_y").agg(F.array_sort(F.collect_list(F.struct("stop_id", "lines"))).alias("s"))  # a tile's stops, some hundred
    rows = tiles.join(held, ["tile_x", "tile_y"], "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<stop_id:string,lines:string>>)")))
    body = F.concat(F.lit("["), F.array_join(F.transform("s", lambda s: F.concat_ws(" ", s["stop_id"], s["lines"])), "; "), F.lit("]"))
    return rows.select("tile_x", "tile_y", F.size("s").cast("long").alias("n"), body.alias("body"))


@query(ON_ROAD + "," + STOPS_SQL + ", v as (select vehicle, " + TILE_SQL + " from latest) select vehicle, count(*) as stops, count(distinct lines) as lines, min(stop_id) as first_stop from v join s on abs(v.tile_x - s.tile_x) <= 1 and abs(v.tile_y - s.tile_y) <= 1 group by vehicle")
def stops_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops in the nine tiles around each vehicle: an equi join on the tile, each place sent to its neighbours' keys."""
    step = F.array(*map(F.lit, (-1, 0, 1)))
    v = fixture.latest(fixture.fixes(spark, sf_dir)).select("vehicle", geo.tile_x(F.col("lon"), ZOOM).alias("vx"), geo.tile_y(F.col("lat"), ZOOM).alias("vy"))
    v = v.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).select("vehicle", (F.col("vx") + F.col("dx")).alias("tile_x"), (F.col("vy") + F.col("dy")).alias("tile_y"))
    rows = v.join(stops_with_lines(spark, sf_dir), ["tile_x", "tile_y"])
    return rows.groupBy("vehicle").agg(F.count("*").alias("stops"), F.countDistinct("lines").alias("lines"), F.min("stop_id").alias("first_stop"))


@query(FX + """, n as (select max(t) as newest from fx), a as (select vendor, newest, max(seen_at) as clock from fx, n where event_id % 7 < 5 or vendor <> 'sonda' group by all), c as (select max(clock) + 60 * (select count(distinct vendor) from a) as now, max(newest) as newest from a)
  select newest, now - newest as age, case when newest = 0 then 'down' when now - newest > 120 then 'stale' else 'ok' end as status, case when pct >= 80 then 'high' else 'ok' end as disk from c, (select 79 + count(distinct vendor) as pct from a)""")
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row on the whole: the newest fix, its age at a clock of a minute a source past the last arrival, and the disk's state."""
    fx = fixture.fixes(spark, sf_dir)
    one = fx.agg(F.coalesce(F.max("t"), F.lit(0)).alias("newest"), F.max(F.when((F.col("event_id") % 7 < 5) | (F.col("vendor") != "sonda"), F.col("seen_at"))).alias("clock"), F.countDistinct("vendor").alias("sources"))
    age = F.col("clock") + 60 * F.col("sources") - F.col("newest")
    status = F.when(F.col("newest") == 0, "down").when(age > 120, "stale").otherwise("ok")
    return one.select("newest", age.alias("age"), status.alias("status"), F.when(79 + F.col("sources") >= 80, "high").otherwise("ok").alias("disk"))


@query(ON_ROAD + """, n as (select max(seen_at) as made from fx), u as (select service, count(*) as n from resolved where route_ix is null group by service), g as (select coalesce(line, service) as line, count(*) as n from resolved group by 1), s as (select vendor, max(t) as newest, count(*) as n from fx group by vendor)
  select to_json({'generated_at': made, 'tracked': (select count(*) from resolved), 'routed': (select count(route_ix) from resolved), 'unknown_services': (select list({'service': service, 'n': n} order by n desc, service) from u),
    'lines': (select list({'line': line, 'n': n} order by n desc, line) from g), 'sources': (select list({'source': vendor, 'newest': newest, 'rows': n} order by vendor) from s)}) as body from n""")
def index_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document that names what was published: counts, unknown services, lines and sources; lists of a network's codes."""
    fx = fixture.fixes(spark, sf_dir)
    road = on_road(spark, sf_dir)
    by_size = lambda k: F.struct((-F.col("n")).alias("o"), k, "n")
    unknown = road.where("route_ix is null").groupBy("service").agg(F.count("*").alias("n")).agg(F.transform(F.array_sort(F.collect_list(by_size("service"))), lambda u: F.struct(u["service"].alias("service"), u["n"].alias("n"))).alias("unknown_services"))
    lines = road.groupBy(F.col("shown").alias("line")).agg(F.count("*").alias("n")).agg(F.transform(F.array_sort(F.collect_list(by_size("line"))), lambda u: F.struct(u["line"].alias("line"), u["n"].alias("n"))).alias("lines"))
    sources = fx.groupBy(F.col("vendor").alias("source")).agg(F.max("t").alias("newest"), F.count("*").alias("rows"), F.max("seen_at").alias("at"))
    sources = sources.agg(F.max("at").alias("generated_at"), F.array_sort(F.collect_list(F.struct("source", "newest", "rows"))).alias("sources"))
    counts = road.agg(F.count("*").alias("tracked"), F.count("route_ix").alias("routed"))
    one = counts.join(F.broadcast(sources)).join(F.broadcast(unknown)).join(F.broadcast(lines))  # one row each
    return one.select(F.to_json(F.struct("generated_at", "tracked", "routed", "unknown_services", "lines", "sources")).alias("body"))


@query("with q as (select p_partkey, trim(substr(p_name, 1, cast(p_partkey % 7 as int))) as q, p_name from part) select p_partkey, q from q where length(q) >= 3")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was typed so far of a name, where it is long enough to be searched for: three characters."""
    q = F.trim(F.substring(F.col("p_name"), F.lit(1), (F.col("p_partkey") % 7).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q")).where(F.length("q") >= 3)


@query(FX + " select event_id, cast(round(lat * 1000000) as int) as lat_e6, cast(round(lon * 1000000) as int) as lon_e6, round(lat, 5) as lat, round(lon, 5) as lon from fx")
def rounded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as whole millionths of a degree, and with the five decimals of a bundle."""
    whole = lambda c: F.round(F.col(c) * 1000000).cast("int")
    return fixture.fixes(spark, sf_dir).select("event_id", whole("lat").alias("lat_e6"), whole("lon").alias("lon_e6"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))
