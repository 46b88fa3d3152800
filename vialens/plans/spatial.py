"""Queries on places: passes along shapes, tiles, nearest stops, yards and their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import geo
from vialens.operators import evidence, spatial
from vialens.plans import fixture
from vialens.plans.fixture import FX, LATEST_SQL, SHAPES_SQL
from vialens.plans.fleet import ON_ROAD, on_road
from vialens.plans.registry import ORACLES, query, table

GOOD = LATEST_SQL.split("latest as")[0].rstrip().rstrip(",")
PASSES_SQL = FX + "," + GOOD + "," + SHAPES_SQL + """,
sg as (select shape_id, i as seg, x as ax, y as ay, lead(x) over w as bx, cum as cum0, lead(cum) over w as cum1 from pts window w as (partition by shape_id order by i)),
tt as (select event_id, shape_id, seg, cum0, cum1, ax, bx, ay, g.x, g.y, greatest(0.0, least(1.0, ((g.x - ax) * (bx - ax)) / ((bx - ax) * (bx - ax)))) as tau from good g join sg on bx is not null and abs(g.y - ay) <= 200 and g.x between least(ax, bx) - 200 and greatest(ax, bx) + 200),
dd as (select *, sqrt(power(x - (ax + tau * (bx - ax)), 2) + power(y - ay, 2)) as dist, cum0 + tau * (cum1 - cum0) as along from tt),
near as (select *, seg - row_number() over (partition by event_id, shape_id order by seg) as run from dd where dist <= 200),
ps as (select event_id, shape_id, cast(min(seg) as int) as first_seg, cast(max(seg) as int) as last_seg, first(along order by dist, seg) as along, min(dist) as dist from near group by event_id, shape_id, run)"""


def all_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = spatial.segments(fixture.points(spark), ["shape_id"])
    return spatial.passes(fixture.good_fixes(fixture.fixes(spark, sf_dir)), segs, "event_id", "shape_id")


@query(PASSES_SQL + " select event_id, shape_id, first_seg, last_seg, round(along, 2) + 0 as along, round(dist, 2) + 0 as dist from ps")
def pass_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place along any shape within 200 m of a fix."""
    return all_passes(spark, sf_dir).select("event_id", "shape_id", "first_seg", "last_seg", (F.round("along", 2) + 0).alias("along"), (F.round("dist", 2) + 0).alias("dist"))


@query(PASSES_SQL + " select event_id, shape_id, round(dist, 2) + 0 as dist, cast(rn as int) as place from (select *, row_number() over (partition by event_id order by round(dist, 2), shape_id, first_seg) as rn from ps) where rn <= 4")
def nearest4_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_passes(spark, sf_dir).withColumn("dist", F.round("dist", 2) + 0)
    place = F.row_number().over(Window.partitionBy("event_id").orderBy("dist", "shape_id", "first_seg"))
    return rows.withColumn("place", place).where("place <= 4").select("event_id", "shape_id", "dist", "place")


LOOP_SQL = """lp as (select i, case when i < 30 then 50.0 * i when i < 60 then 1500.0 when i < 90 then 1500.0 - 50.0 * (i - 60) else 0.0 end as x, case when i < 30 then 0.0 when i < 60 then 50.0 * (i - 30) when i < 90 then 1500.0 when i < 120 then 1500.0 - 50.0 * (i - 90) else 0.0 end as y from range(121) t(i)),
lg as (select i as seg, x as ax, y as ay, lead(x) over (order by i) as bx, lead(y) over (order by i) as by_ from lp),
lt as (select event_id, seg, ax, ay, bx, by_, g.x, g.y, greatest(0.0, least(1.0, ((g.x - ax) * (bx - ax) + (g.y - ay) * (by_ - ay)) / 2500.0)) as tau from good g join lg on bx is not null and g.x between least(ax, bx) - 200 and greatest(ax, bx) + 200 and g.y between least(ay, by_) - 200 and greatest(ay, by_) + 200),
ld as (select event_id, seg, 50.0 * (seg + tau) as along, sqrt(power(x - ax - tau * (bx - ax), 2) + power(y - ay - tau * (by_ - ay), 2)) as dist from lt),
twice as (select *, lap, seg + 120 * lap as place from ld, range(2) l(lap) where dist <= 200),
island as (select *, place - row_number() over (partition by event_id order by place) as run from twice),
whole as (select event_id, min(place) as a, max(place) as z, first(along order by dist, seg) as along, min(dist) as dist from island group by event_id, run),
seam as (select event_id, bool_or(seg = 119) as wraps from ld where dist <= 200 group by event_id)"""


@query(FX + "," + GOOD + "," + LOOP_SQL + """ select event_id, cast(a as int) as first_seg, cast(z % 120 as int) as last_seg, round(along, 2) + 0 as along, round(dist, 2) + 0 as dist
  from whole join seam using (event_id) where a < 120 and not (a = 0 and wraps)""")
def loop_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place along a circular route of 6 km within 200 m of a fix; the SQL walks the route twice instead."""
    i = F.col("id").cast("int")
    side, along = F.floor(i / 30), (i % 30) * 50.0
    x = F.when(side == 0, along).when(side == 1, 1500.0).when(side == 2, 1500.0 - along).otherwise(0.0)
    y = F.when(side == 0, 0.0).when(side == 1, along).when(side == 2, 1500.0).when(side == 3, 1500.0 - along).otherwise(0.0)
    segs = spatial.segments(spark.range(121).select(F.lit("loop").alias("shape_id"), i.alias("i"), x.alias("x"), y.alias("y"), (i * 50.0).alias("cum")), ["shape_id"])
    loops = segs.groupBy("shape_id").agg(F.max("seg").alias("last"))
    rows = spatial.passes(fixture.good_fixes(fixture.fixes(spark, sf_dir)), segs, "event_id", "shape_id", loops=loops, from_start=True)
    return rows.select("event_id", "first_seg", "last_seg", (F.round("along", 2) + 0).alias("along"), (F.round("dist", 2) + 0).alias("dist"))


@query(FX + "," + LATEST_SQL + "," + SHAPES_SQL + """ select vehicle, stop_id, round(d, 2) as metres from (select vehicle, stop_id, d, row_number() over (partition by vehicle order by round(d, 2), stop_id) as rn
  from (select distinct vehicle, stop_id, 12742000.0 * asin(sqrt(power(sin(radians((s.y / 111194.92664455873 + -22.9) - lat) / 2), 2) + cos(radians(lat)) * cos(radians(s.y / 111194.92664455873 + -22.9)) * power(sin(radians((s.x / 102431.14359791845 + -43.4) - lon) / 2), 2))) as d from latest, stp s)) where rn = 1""")
def haversine_nearest_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest stop of each vehicle on the sphere, searched for in rings of cells on the plane."""
    sphere = lambda x, y, px, py: F.round(geo.haversine(geo.lat_of(y), geo.lon_of(x), geo.lat_of(py), geo.lon_of(px)), 2)
    return spatial.nearest_by_rings(fixture.latest(fixture.fixes(spark, sf_dir)), fixture.stops(spark), "vehicle", "stop_id", 500.0, sphere, slack=0.99)


def standing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spatial.standing(fixture.good_fixes(fixture.fixes(spark, sf_dir))).where("standing")
    return rows.groupBy(F.floor(F.col("x") / 60).alias("cx"), F.floor(F.col("y") / 60).alias("cy")).agg(F.countDistinct("vehicle").alias("buses"))


@query(FX + "," + GOOD + """, b as (select *, x between 5850 and 6150 and y between -30 and 270 as inside from good) select vehicle, count(*) filter (where inside) as inside, count(*) as n from b group by vehicle""")
def in_garage(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame([(5850.0, -30.0, 6150.0, 270.0)], "x0 double, y0 double, x1 double, y1 double").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    rows = fixture.good_fixes(fixture.fixes(spark, sf_dir)).join(F.broadcast(boxes))
    hit = F.exists("boxes", lambda b: F.col("x").between(b["x0"], b["x1"]) & F.col("y").between(b["y0"], b["y1"]))
    return rows.groupBy("vehicle").agg(F.count_if(hit).alias("inside"), F.count("*").alias("n"))


@query(FX + "," + GOOD + "," + SHAPES_SQL + """, sg as (select shape_id, route_ix, unnest([x, x - 50, x + 50]) as sx, y from pts),
  cells as (select distinct route_ix, cast(floor(sx / 100) as bigint) + dx as cx, cast(floor(y / 100) as bigint) + dy as cy from sg, (values (-1), (0), (1)) a(dx), (values (-1), (0), (1)) b(dy))
  select coalesce(service, '') as service, route_ix, count(*) as n from (select distinct event_id, service, route_ix from good g join cells on cells.cx = floor(g.x / 100) and cells.cy = floor(g.y / 100) where abs(g.y - route_ix * 1500) <= 60 and g.x between -60 and 12060) group by all""")
def alias_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each service code is seen within 60 m of each route's road."""
    segs = spatial.segments(fixture.points(spark), ["shape_id", "route_ix"])
    rows = fixture.good_fixes(fixture.fixes(spark, sf_dir)).select("event_id", "service", "x", "y")
    met = spatial.near_segments(rows, segs, 60.0).select("event_id", "service", "route_ix").distinct()
    return met.groupBy(F.coalesce("service", F.lit("")).alias("service"), "route_ix").agg(F.count("*").alias("n"))


@query("""with p as (select l_orderkey, l_linenumber, l_quantity as x, l_extendedprice / 1000 as y from lineitem), r as (select l_orderkey, list(x order by l_linenumber, x, y) as xs, list(y order by l_linenumber, x, y) as ys, count(*) as n from p group by l_orderkey having count(*) >= 3)
  select l_orderkey, round(list_sum(list_transform(range(1, n + 1), lambda i: xs[i] * ys[i % n + 1] - xs[i % n + 1] * ys[i])) / 2, 1) + 0 as area from r""")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed areas of rings, here of each order's lines as points."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")))).alias("p")).where(F.size("p") >= 3)
    return rows.select("l_orderkey", (F.round(geo.ring_area(F.col("p")), 1) + 0).alias("area"))


@query(FX + " select event_id, round(degrees(atan(sinh(pi() * (1 - 2 * ((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2))))), 6) as lat from fx")
def mercator_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latitude to a Mercator tile's share and back."""
    r = F.radians("lat")
    share = (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0
    return fixture.fixes(spark, sf_dir).select("event_id", F.round(F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * share)))), 6).alias("lat"))


@query(ON_ROAD + "," + SHAPES_SQL + """, o as (select vehicle, shape_id, s.direction, greatest(0.0, least(12000.0, case when direction = 0 then resolved.x else 12000.0 - resolved.x end)) as along from resolved join shp s on s.route_ix = resolved.route_ix),
  nxt as (select o.*, (select min(ord) from stp where stp.shape_id = o.shape_id and stp.dist > o.along - 5) as first_ord from o)
  select vehicle, shape_id, stop_id, cast(ord - first_ord as int) as stops_away, round(dist - along, 2) as metres, round(0.7 * greatest(dist - along, 0) / v, 2) as eta_lo, round(1.4 * greatest(dist - along, 0) / v + 30, 2) as eta_hi
  from (select nxt.*, ord, stop_id, dist, greatest(8.0 / 3.6, least(40.0 / 3.6, exp(-greatest(dist - along, 0) / 1500.0) * 7.5 + (1 - exp(-greatest(dist - along, 0) / 1500.0)) * 6.0)) as v from nxt join stp using (shape_id) where ord >= first_ord and ord < first_ord + 25 and dist - along <= 8000)""")
def arrivals_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stops ahead of each vehicle on its road, either way: at most 25 and 8,000 m, with a range of seconds."""
    return _ahead(spark, sf_dir)


def ahead_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals ahead of every vehicle on a route, with its line and time."""
    rows = on_road(spark, sf_dir)
    shapes = fixture.stops(spark).groupBy("route_ix", "shape_id", "direction").agg(F.array_sort(F.collect_list(F.struct("ord", "dist", "stop_id"))).alias("stops"))
    on = rows.join(F.broadcast(shapes), "route_ix")
    along = F.greatest(F.lit(0.0), F.least(F.lit(12000.0), F.when(F.col("direction") == 0, F.col("x")).otherwise(12000.0 - F.col("x"))))
    on = on.withColumn("along", along)
    nxt = F.slice(F.filter("stops", lambda s: s["dist"] > F.col("along") - 5), 1, 25)
    out = on.select("vehicle", "line", "t", "shape_id", "direction", "along", F.posexplode(F.filter(nxt, lambda s: s["dist"] - F.col("along") <= 8000)).alias("stops_away", "s"))
    metres = F.col("s.dist") - F.col("along")
    lo, hi = geo.eta_bounds(metres, F.lit(7.5), F.lit(None).cast("double"), F.lit(6.0))
    return out.select("vehicle", "line", "t", "direction", "shape_id", F.col("s.stop_id").alias("stop_id"), "stops_away", F.round(metres, 2).alias("metres"), F.round(lo, 2).alias("eta_lo"), F.round(hi, 2).alias("eta_hi"))


def _ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ahead_rows(spark, sf_dir).drop("line", "t", "direction")


@query("select stop_id, shape_id, vehicle, metres, cast(rn as int) as place from (select *, row_number() over (partition by stop_id, shape_id order by metres, vehicle) as rn from (" + ORACLES["arrivals_ahead"] + ")) where rn <= 3")
def arrivals_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next three vehicles of each stop and direction."""
    place = F.row_number().over(Window.partitionBy("stop_id", "shape_id").orderBy("metres", "vehicle"))
    return _ahead(spark, sf_dir).withColumn("place", place).where("place <= 3").select("stop_id", "shape_id", "vehicle", "metres", "place")


@query("select stop_id, vehicle, eta_lo, eta_hi from (" + ORACLES["arrivals_ahead"] + ") where stop_id = 'p1_6' order by (eta_lo + eta_hi) / 2, vehicle")
def stop_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes to one stop, soonest first."""
    return _ahead(spark, sf_dir).where("stop_id = 'p1_6'").select("stop_id", "vehicle", "eta_lo", "eta_hi").orderBy((F.col("eta_lo") + F.col("eta_hi")) / 2, "vehicle")


@query("select vehicle, shape_id, first(stop_id order by stops_away) as stop_id, count(*) as ahead from (" + ORACLES["arrivals_ahead"] + ") group by vehicle, shape_id")
def next_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ahead(spark, sf_dir).groupBy("vehicle", "shape_id").agg(F.min_by("stop_id", "stops_away").alias("stop_id"), F.count("*").alias("ahead"))


@query(FX + "," + GOOD + """, m as (select vehicle, service, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) / (t - lag(t) over w) as v from good window w as (partition by vehicle order by t, event_id)),
  l as (select service, vehicle, round(max(v) filter (where v <= 27), 3) as v from m group by all having max(v) filter (where v <= 27) is not null)
  select service, count(*) as n, list_sort(list(v))[count(*) // 2 + 1] as median from l group by service having count(*) >= 3""")
def line_upper_median_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of a line's vehicle speeds, with three vehicles at least; a line's vehicles fit in an array."""
    w = Window.partitionBy("vehicle").orderBy("t", "event_id")
    rows = fixture.good_fixes(fixture.fixes(spark, sf_dir))
    v = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    rows = rows.select("vehicle", "service", F.try_divide(v, F.col("t") - F.lag("t").over(w)).alias("v")).where("v <= 27")
    fast = rows.groupBy("service", "vehicle").agg(F.round(F.max("v"), 3).alias("v"))
    line = fast.groupBy("service").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("v")).alias("vs")).where("n >= 3")
    return line.select("service", "n", F.get("vs", F.floor(F.col("n") / 2).cast("int")).alias("median"))


@query(FX + "," + GOOD + """, j as (select event_id, (event_id * 37) % 12000 as a, (event_id * 91) % 12000 as b, event_id % 2 = 0 as circular from fx)
  select event_id, cast(case when not circular then b - a when (b - a) % 12000 > 6000 then (b - a) % 12000 - 12000 when (b - a) % 12000 < -6000 then (b - a) % 12000 + 12000 else (b - a) % 12000 end as double) as delta from j""")
def loop_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 12000).cast("double").alias("a"), (F.col("event_id") * 91 % 12000).cast("double").alias("b"))
    return rows.select("event_id", geo.loop_delta(F.col("a"), F.col("b"), F.lit(12000.0), F.col("event_id") % 2 == 0).alias("delta"))


@query("with " + SHAPES_SQL.strip() + """, e as (select event_id, (event_id * 53) % 12300 - 100 as raw from events), a as (select *, greatest(0, least(12000, raw)) as along from e)
  select event_id, shape_id, round(cast(case when direction = 0 then along else 12000 - along end as double), 3) as x, case when direction = 0 then 90.0 else 270.0 end as bearing from a, shp""")
def shape_point_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point and bearing at a distance along a shape: an equi join on the 50 m segment that holds it."""
    at = table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0), F.least(F.lit(12000), F.col("event_id") * 53 % 12300 - 100)).cast("double").alias("along"))
    at = at.withColumn("seg", F.least(F.lit(239), F.floor(F.col("along") / 50)).cast("int"))
    segs = spatial.segments(fixture.points(spark), ["shape_id"])
    rows = at.join(F.broadcast(segs), "seg")
    share = (F.col("along") - F.col("cum0")) / (F.col("cum1") - F.col("cum0"))
    return rows.select("event_id", "shape_id", F.round(F.col("ax") + share * (F.col("bx") - F.col("ax")), 3).alias("x"), geo.bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("bearing"))


@query("with " + SHAPES_SQL.strip() + ", " + FX.removeprefix("with ") + "," + LATEST_SQL + """ , ends as (select shape_id, x, y from pts where i in (0, 240))
  select vehicle, round(min(sqrt(power(e.x - l.x, 2) + power(e.y - l.y, 2))), 2) as metres from latest l, ends e group by vehicle""")
def nearest_route_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vehicle is from the nearest end of any route, searched for in rings of cells."""
    ends = fixture.points(spark).where("i in (0, 240)").select(F.concat_ws("-", "shape_id", "i").alias("end_id"), "x", "y")
    found = spatial.nearest_by_rings(fixture.latest(fixture.fixes(spark, sf_dir)), ends, "vehicle", "end_id", 500.0)
    return found.select("vehicle", F.round("metres", 2).alias("metres"))


@query("""with p as (select l_orderkey as o, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, cast(l_partkey * 13 % 1700 as double) as x, cast(l_suppkey * 71 % 1300 as double) as y from lineitem),
  s as (select *, lead(x) over w as bx, lead(y) over w as by_ from p window w as (partition by o order by i)),
  n as (select *, greatest(1, cast(floor(sqrt(power(bx - x, 2) + power(by_ - y, 2)) / 100) as bigint) + 1) as n from s where bx is not null),
  k as (select *, unnest(range(n + 1)) as k from n),
  c as (select distinct o, cast(floor((x + (bx - x) * k / n) / 100) as bigint) as cx, cast(floor((y + (by_ - y) * k / n) / 100) as bigint) as cy from k)
  select o as route, count(*) as cells, min(cx) as x0, max(cx) as x1, min(cy) as y0, max(cy) as y1 from c group by o""")
def grid_rasterise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 m cells that each route crosses, slanted segments walked in steps: orders as routes, their lines as points.

    A route's points and cells are arrays of one row, so that a task holds a route's cells and not those of all its routes.
    """
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_partkey") * 13 % 1700).cast("double").alias("x"), (F.col("l_suppkey") * 71 % 1300).cast("double").alias("y"))
    routes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.sort_array(F.collect_list(at)).alias("p"))
    # told by the points and not by the cells, which would be found once more for it
    routes = routes.where(F.exists(F.slice("p.x", F.lit(2), F.size("p")), lambda x: x.isNotNull()))
    rows = routes.select("route", evidence.cells_of_path(F.arrays_zip(F.col("p.x").alias("x"), F.col("p.y").alias("y")), 100.0).alias("c"))
    ends = (f(F.col(f"c.{n}")).alias(f"{n[1]}{k}") for n in ("cx", "cy") for k, f in ((0, F.array_min), (1, F.array_max)))
    return rows.select("route", F.size("c").cast("long").alias("cells"), *ends)


@query("with t as (" + ORACLES["arrivals_ahead"] + """), p as (select distinct stop_id, x / 102431.14359791845 - 43.4 as lon, y / 111194.92664455873 - 22.9 as lat from (""" + FX + "," + LATEST_SQL + "," + SHAPES_SQL + """ select * from stp)),
  q as (select stop_id, cast(floor((lon + 180) / 360 * 8192) as int) as tile_x, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192) as int) as tile_y from p)
  select tile_x, tile_y, count(distinct stop_id) as stops, count(*) as arrivals, count(distinct vehicle) as buses, min(metres) as nearest_m from t join q using (stop_id) group by all""")
def arrivals_by_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals of each map tile's stops: stops, arrivals, buses and the nearest one's metres."""
    places = fixture.stops(spark).select("stop_id", geo.tile_x(geo.lon_of(F.col("x")), 13).alias("tile_x"), geo.tile_y(geo.lat_of(F.col("y")), 13).alias("tile_y")).distinct()
    rows = _ahead(spark, sf_dir).join(F.broadcast(places), "stop_id")  # a network's stops
    return rows.groupBy("tile_x", "tile_y").agg(F.countDistinct("stop_id").alias("stops"), F.count("*").alias("arrivals"), F.countDistinct("vehicle").alias("buses"), F.min("metres").alias("nearest_m"))
