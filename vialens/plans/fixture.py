"""A fleet derived from the events table by integer arithmetic: 40 vehicles on four roads, one fix each 20 s.

The same text runs in Spark SQL and in DuckDB. Vehicles 0 to 31 move 150 m a step on east-west roads of 12 km, the others
stand in a yard. Some fixes are late, early, far away, out of service or jump by 3 km.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vialens.constants import PARKED_S
from vialens.functions import codes, geo
from vialens.operators import spatial

FIXES_SQL = """
with b as (select event_id, event_type, value, event_id % 40 as v, cast((event_id - event_id % 40) / 40 as bigint) as k from {events}),
g as (select *, v % 4 as r, (v * 617 + k * 150) % 24000 as p from b),
h as (select *, case when v >= 32 then 6000 + (v - 32) * 10 when p <= 12000 then p else 24000 - p end as road_m,
        case when v >= 32 then 120 else r * 1500 end as road_y, case when p < 12000 then 0 else 1 end as dir_id,
        (event_id * 7919) % 41 - 20 as jitter_m from g)
select event_id, concat('V', lpad(cast(v as string), 3, '0')) as vehicle,
  case event_type when 'click' then 'zirix' when 'view' then 'conecta' when 'signup' then 'maxtrack' when 'purchase' then 'sonda' else 'unknown' end as vendor,
  1800000000 + 20 * k + v % 7 - case when event_id % 101 = 0 then 400 else 0 end + case when event_id % 103 = 0 then 120 else 0 end as t,
  1800000000 + 20 * k + v % 7 + 5 as seen_at,
  cast(-22.9 as double) + cast(road_y + jitter_m as double) * cast(8.993216059187306e-06 as double)
    + case when event_id % 211 = 0 then cast(1 as double) else cast(0 as double) end as lat,
  cast(-43.4 as double) + cast(road_m + case when event_id % 307 = 0 then 3000 else 0 end as double) * cast(9.762655818091652e-06 as double) as lon,
  case when event_id % 997 = 0 then 'GARAGEM' when event_type = 'error' then null
       else case r when 0 then '474' when 1 then '7' when 2 then '685' else '959' end end as service,
  case when value < 5 then null when dir_id = 0 then cast(90 as double) else cast(270 as double) end as heading,
  case when value < 20 then null when dir_id = 0 then 'ida' else 'volta' end as sentido
from h"""
#: For DuckDB: common table expressions that a query's SQL starts with.
FX = "with fx as (" + FIXES_SQL.format(events="events") + ")"
ROUTES = [(0, "474"), (1, "007"), (2, "LECD140")]
ALIASES = [("685", "LECD140")]
ROUTES_SQL = "routes(route_ix, short_name) as (values (0, '474'), (1, '007'), (2, 'LECD140')), aliases(alias, target) as (values ('685', 'LECD140'))"
#: Stops each 1,000 m and points each 50 m of each road and direction, in DuckDB.
SHAPES_SQL = """
shp as (select r as route_ix, d as direction, concat('s', r, '_', d) as shape_id from range(3) t(r), range(2) u(d)),
pts as (select s.*, i, case when direction = 0 then 50.0 * i else 12000.0 - 50.0 * i end as x, route_ix * 1500.0 as y, 50.0 * i as cum from shp s, range(241) t(i)),
stp as (select s.*, i as ord, 1000.0 * i as dist, concat('p', route_ix, '_', case when direction = 0 then i else 12 - i end) as stop_id,
          case when direction = 0 then 1000.0 * i else 12000.0 - 1000.0 * i end as x, route_ix * 1500.0 as y from shp s, range(13) t(i))"""
#: Each vehicle's last good fix in DuckDB, with its route and its place along the road.
LATEST_SQL = """
good as (select *, (lon - -43.4) * 102431.14359791845 as x, (lat - -22.9) * 111194.92664455873 as y from fx
  where lat between -23.15 and -22.65 and lon between -43.9 and -43.0 and t <= seen_at + 60 and seen_at - t <= 300 and service is not null and service <> 'GARAGEM'),
latest as (select * from (select *, row_number() over (partition by vehicle order by t desc, event_id desc) as rn from good) where rn = 1)"""


def standing_sql(before: int, after: int) -> str:
    """DuckDB's ``stood``: the good fixes with whether over half of the vehicle's fixes in the time around, three at least, lie within 100 m of their median place."""
    return f"""
around as (select *, list(x) over w as xs, list(y) over w as ys from good window w as (partition by vehicle order by t range between {before} preceding and {after} following)),
middle as (select *, list_sort(xs)[(len(xs) + 1) // 2] as mx, list_sort(ys)[(len(ys) + 1) // 2] as my from around),
stood as (select * exclude (xs, ys, mx, my), len(xs) >= 3 and 2 * len(list_filter(range(1, len(xs) + 1), lambda i: sqrt(power(xs[i] - mx, 2) + power(ys[i] - my, 2)) <= 100)) > len(xs) as standing from middle)"""


#: Each vehicle's last good fix in DuckDB, with whether it has stood in the 600 s up to then.
LATEST_STANDING_SQL = LATEST_SQL.split("latest as")[0] + standing_sql(600, 0).lstrip() + """,
latest as (select * from (select *, row_number() over (partition by vehicle order by t desc, event_id desc) as rn from stood) where rn = 1)"""


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FIXES_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def repeated_fixes(fx: DataFrame) -> DataFrame:
    """The fixes with every fiftieth reported once more a second later."""
    again = fx.where("event_id % 50 = 0").withColumn("seen_at", F.col("seen_at") + 1)
    return fx.unionByName(again)


def routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROUTES, "route_ix int, short_name string")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, target string")


def shapes(spark: SparkSession) -> DataFrame:
    return spark.range(6).select((F.col("id") / 2).cast("int").alias("route_ix"), (F.col("id") % 2).cast("int").alias("direction")).withColumn("shape_id", F.concat(F.lit("s"), "route_ix", F.lit("_"), "direction"))


def _along(shapes_: DataFrame, n: int, step: float, name: str) -> DataFrame:
    on = shapes_.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = F.col("i") * step
    return on.withColumn(name, place).withColumn("x", F.when(F.col("direction") == 0, place).otherwise(12000.0 - place)).withColumn("y", F.col("route_ix") * 1500.0)


def points(spark: SparkSession) -> DataFrame:
    return _along(shapes(spark), 241, 50.0, "cum")


def stops(spark: SparkSession) -> DataFrame:
    rows = _along(shapes(spark), 13, 1000.0, "dist").withColumnRenamed("i", "ord")
    return rows.withColumn("stop_id", F.concat(F.lit("p"), "route_ix", F.lit("_"), F.when(F.col("direction") == 0, F.col("ord")).otherwise(12 - F.col("ord"))))


def good_fixes(fx: DataFrame) -> DataFrame:
    """Fixes that pass the stateless rules and name a service, with plane coordinates."""
    ok = geo.in_area(F.col("lat"), F.col("lon")) & (F.col("t") <= F.col("seen_at") + 60) & (F.col("seen_at") - F.col("t") <= 300)
    return fx.where(ok & (codes.service_state(F.col("service")) == "named")).withColumn("x", geo.x_of(F.col("lon"))).withColumn("y", geo.y_of(F.col("lat")))


def latest(fx: DataFrame) -> DataFrame:
    """Each vehicle's newest good fix: one aggregate, no window over a vehicle's history."""
    g = good_fixes(fx)
    best = g.groupBy("vehicle").agg(F.max_by(F.struct(*[c for c in g.columns if c != "vehicle"]), F.struct("t", "event_id")).alias("f"))
    return best.select("vehicle", "f.*")


def latest_standing(fx: DataFrame) -> DataFrame:
    """``latest`` with whether each vehicle has stood in the time up to then."""
    stood = spatial.standing(good_fixes(fx), before=PARKED_S, after=0)
    best = stood.groupBy("vehicle").agg(F.max_by(F.struct(*[c for c in stood.columns if c != "vehicle"]), F.struct("t", "event_id")).alias("f"))
    return best.select("vehicle", "f.*")
