"""Queries of the map build, on rings and roads made of the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import basemap, geo
from vialens.operators import basemap as build
from vialens.plans import fixture
from vialens.plans.registry import query, table

LAYERS = ["water", "landuse", "landcover", "roads", "places"]
KINDS = ["lake", "fountain", "park", "meadow", "beach", "industrial", "highway", "medium_road", "minor_road", "path"]
FEATURES_SQL = f"""f as (select event_id, {LAYERS}[event_id % 5 + 1] as layer, case when event_id % 5 = 3 then 2 else 3 end as geometry, {KINDS}[event_id // 5 % 10 + 1] as kind, 12 + event_id % 4 as zoom from events)"""


@query("with " + FEATURES_SQL + """, p as (select zoom, case when layer = 'water' and kind not in ('fountain', 'swimming_pool') then 'water' when layer like 'land%' and kind in ('park', 'meadow') then 'green' when layer like 'land%' and kind = 'beach' then 'sand'
  when layer = 'roads' and kind = 'highway' then 'road0' when layer = 'roads' and kind = 'medium_road' then 'road1' when layer = 'roads' and kind = 'minor_road' and zoom >= 13 then 'road2' end as part from f)
  select zoom, part, cast(case part when 'water' then 20 when 'sand' then 40 when 'green' then if(zoom = 15, 120, 60) end as double) as least, count(*) as n from p where part is not null group by all""")
def basemap_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of each zoom are drawn in each part of the map, and the least area there."""
    k = F.col("event_id")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    f = table(spark, sf_dir, "events").select(pick(LAYERS, k % 5).alias("layer"), F.when(k % 5 == 3, basemap.LINE).otherwise(basemap.POLYGON).alias("geometry"), pick(KINDS, F.floor(k / 5) % 10).alias("kind"), (k % 4 + 12).alias("zoom"))
    part = basemap.drawn_as(F.col("layer"), F.col("geometry"), F.col("kind"), F.col("zoom"))
    rows = f.select("zoom", part.alias("part")).where("part is not null").groupBy("zoom", "part").agg(F.count("*").alias("n"))
    return rows.select("zoom", "part", basemap.least_area(F.col("part"), F.col("zoom")).alias("least"), "n")


RINGS_SQL = """with p as (select o_custkey, l_orderkey, l_linenumber, cast(l_quantity as double) as x, cast(l_extendedprice as double) / 1000 as y from lineitem join orders on o_orderkey = l_orderkey),
r as (select o_custkey, l_orderkey, list(x order by l_linenumber, x, y) as xs, list(y order by l_linenumber, x, y) as ys, count(*) as n from p group by all),
a as (select o_custkey, l_orderkey, n, list_sum(list_transform(range(1, n + 1), lambda i: xs[i] * ys[i % n + 1] - xs[i % n + 1] * ys[i])) / 2 as area from r)"""


@query(RINGS_SQL + """, k as (select *, coalesce(last_value(case when area > 0 then area >= 60 end ignore nulls) over (partition by o_custkey order by l_orderkey rows unbounded preceding), false) as ok from a)
  select o_custkey, l_orderkey, round(area, 1) as area from k where ok and abs(area) >= 60 and n >= 3""")
def ring_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings that a map of least area 60 draws: each customer's orders as the rings of one feature."""
    at = F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    rings = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(at)).alias("p"))
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    rows = rings.select("l_orderkey", geo.ring_area(F.col("p")).alias("area"), F.size("p").alias("points")).join(owner, "l_orderkey")
    return build.kept_rings(rows, "o_custkey", "l_orderkey", 60.0).select("o_custkey", "l_orderkey", F.round("area", 1).alias("area"))


@query("""with p as (select l_orderkey as road, o_custkey % 50 as tile, o_orderpriority as name, cast(l_quantity as double) as x, cast(l_extendedprice as double) / 1000 as y, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity, l_extendedprice) as i from lineitem join orders on o_orderkey = l_orderkey),
  s as (select *, lead(x) over w as nx, lead(y) over w as ny from p window w as (partition by road order by i)), d as (select *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) as d, degrees(atan2(ny - y, nx - x)) as a from s where nx is not null),
  b as (select * from d qualify row_number() over (partition by road order by d desc, i) = 1), l as (select * from b where d > 30 qualify row_number() over (partition by tile, name order by road) = 1)
  select tile, name, road, cast(round((x + nx) / 2) as int) as x, cast(round((y + ny) / 2) as int) as y, cast(round(case when a > 90 then a - 180 when a < -90 then a + 180 else a end) as int) as angle from l""")
def road_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label a road name and tile, on the longest straight stretch: orders as roads, their lines as points."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice"))
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", i.alias("i"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    roads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("tile"), F.col("o_orderpriority").alias("name"))
    return build.road_labels(p.join(roads, "l_orderkey").withColumnRenamed("l_orderkey", "road"), 30.0)


MAP_SQL = """with n as (select l_orderkey as o, case l_orderkey % 3 when 0 then 11 when 1 then 13 else 15 end as z, 700 + l_orderkey % 7 as x, 900 + l_orderkey % 5 as y, l_suppkey % 6 as kind, concat('Rua ', l_returnflag, l_linestatus) as name,
    [l_partkey * 37 % 4096, l_partkey * 91 % 4096, (l_partkey * 37 + l_linenumber * 129) % 4096] as px, [l_suppkey * 53 % 4096, (l_suppkey * 53 + cast(l_quantity as bigint) * 40) % 4096, l_partkey * 17 % 4096] as py,
    row_number() over (partition by l_orderkey % 105 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as ix from lineitem),
  f as (select *, case kind when 0 then 'w' when 1 then 'g' when 2 then 's' when 3 then 'r0' when 4 then 'r1' when 5 then if(z >= 13, 'r2', null) end as part, list_transform(px, lambda v: v / 4.0) as a, list_transform(py, lambda v: v / 4.0) as b, z >= 15 as near from n),
  m as (select *, (a[1] * b[2] - a[2] * b[1] + a[2] * b[3] - a[3] * b[2] + a[3] * b[1] - a[1] * b[3]) / 2 as area, abs((a[2] - a[1]) * (b[3] - b[1]) - (b[2] - b[1]) * (a[3] - a[1])) / greatest(sqrt(power(a[3] - a[1], 2) + power(b[3] - b[1], 2)), 1e-9) as off from f where part is not null),
  q as (select *, [round(a[1]), round(a[2]), round(a[3])] as ra, [round(b[1]), round(b[2]), round(b[3])] as rb from m),
  rings as (select z, x, y, part, ix, '[[' || ra[1]::int || ',' || rb[1]::int || ',' || ra[2]::int || ',' || rb[2]::int || ',' || ra[3]::int || ',' || rb[3]::int || ']]' as body from q
    where kind < 3 and area >= case part when 'w' then 20 when 's' then 40 else if(near, 120, 60) end and off > if(near, 2.0, 1.4) and (ra[1], rb[1]) <> (ra[2], rb[2]) and (ra[2], rb[2]) <> (ra[3], rb[3])),
  roads as (select z, x, y, part, ix, '[' || ra[1]::int || ',' || rb[1]::int || ',' || ra[2]::int || ',' || rb[2]::int || ']' as body from q where kind >= 3 and (ra[1], rb[1]) <> (ra[2], rb[2])),
  lab as (select z, x, y, name, ix, kind - 3 as class, (a[1] + a[2]) / 2 as mx, (b[1] + b[2]) / 2 as my, degrees(atan2(b[2] - b[1], a[2] - a[1])) as t from q
    where z = 15 and kind in (3, 4) and (ra[1], rb[1]) <> (ra[2], rb[2]) and sqrt(power(a[2] - a[1], 2) + power(b[2] - b[1], 2)) > 90 qualify row_number() over (partition by z, x, y, name order by ix) = 1),
  part_ as (select z, x, y, part, '[' || string_agg(body, ',' order by ix) || ']' as body from (select * from rings union all select * from roads) group by all
    union all select z, x, y, 'l', '[' || string_agg('[' || round(mx)::int || ',' || round(my)::int || ',' || round(case when t > 90 then t - 180 when t < -90 then t + 180 else t end)::int || ',' || to_json(name)::varchar || ',' || class || ']', ',' order by name) || ']' from lab group by all)
  select z, cast(x as int) as x, cast(y as int) as y, '{' || string_agg('"' || part || '":' || body, ',' order by list_position(['w', 'g', 's', 'r0', 'r1', 'r2', 'l'], part)) || '}' as body from part_ group by all having bool_or(part <> 'l')"""


@query(MAP_SQL)
def map_tile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a map draws of 105 tiles: order lines as triangles of water, green and sand and as named roads of two points."""
    kinds = ["lake", "park", "beach", "highway", "medium_road", "minor_road"]
    k, o = F.col("l_suppkey") % 6, F.col("l_orderkey")
    order = Window.partitionBy(o % 105).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    at = lambda x, y: F.struct((x % 4096).cast("int").alias("x"), (y % 4096).cast("int").alias("y"))
    a = at(F.col("l_partkey") * 37, F.col("l_suppkey") * 53)
    b = at(F.col("l_partkey") * 91, F.col("l_suppkey") * 53 + F.col("l_quantity").cast("long") * 40)
    c = at(F.col("l_partkey") * 37 + F.col("l_linenumber") * 129, F.col("l_partkey") * 17)
    layer = F.when(k == 0, "water").when(k == 1, "landuse").when(k == 2, "landcover").otherwise("roads")
    kind = F.get(F.array(*map(F.lit, kinds)), k.cast("int"))
    features = table(spark, sf_dir, "lineitem").select(
        F.lit(0).cast("long").alias("tile_id"), F.when(o % 3 == 0, 11).when(o % 3 == 1, 13).otherwise(15).alias("z"), (700 + o % 7).cast("int").alias("x"), (900 + o % 5).cast("int").alias("y"), (F.row_number().over(order) - 1).alias("ix"),
        layer.alias("layer"), F.when(k < 3, basemap.POLYGON).otherwise(basemap.LINE).alias("geom_type"), F.lit(4096).alias("extent"), F.create_map(F.lit("kind"), kind, F.lit("name"), F.concat(F.lit("Rua "), "l_returnflag", "l_linestatus")).alias("props"), F.when(k < 3, F.array(F.array(a, b, c))).otherwise(F.array(F.array(a, b))).alias("parts"),
    )
    return build.map_tiles(features)


@query("""with recursive s as (select p_brand as name, p_size % 3 as rank, p_partkey as id, -22.75 - (p_partkey * 7 % 1000) / 50000.0 as lat, -43.2 - (p_partkey * 13 % 1000) / 50000.0 as lon from part),
  p as (select *, (lon - -43.4) * 102431.14359791845 as x, (lat - -22.9) * 111194.92664455873 as y, row_number() over (partition by name order by rank, id) as k from s),
  g(name, k, kept) as (select distinct name, cast(0 as bigint), cast([] as struct(id bigint, rank int, x double, y double)[]) from p union all
    select p.name, p.k, case when len(list_filter(g.kept, lambda c: sqrt(power(c.x - p.x, 2) + power(c.y - p.y, 2)) < 1000)) > 0 then g.kept else list_append(g.kept, {'id': p.id, 'rank': p.rank, 'x': p.x, 'y': p.y}) end from g join p on p.name = g.name and p.k = g.k + 1),
  z as (select name, unnest(last(kept order by k)) as c from g group by name) select name, cast(c.rank as int) as rank, cast(c.id as bigint) as id from z""")
def ranked_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named places, the most important of a name first, those within 1,000 m of one of the name left out: parts as places of their brand."""
    k = F.col("p_partkey")
    places = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 3).cast("int").alias("rank"), (-22.75 - (k * 7 % 1000) / 50000.0).alias("lat"), (-43.2 - (k * 13 % 1000) / 50000.0).alias("lon"), k.cast("long").alias("tile_id"), F.lit(0).alias("ix"))
    return build.ranked_places(places).select("name", "rank", F.col("tile_id").alias("id"))


@query("select event_id, round(-180 + 360 * ((lon + 180) / 360), 6) as lon, round(degrees(atan(sinh(pi() * (1 - 2 * ((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2))))), 6) as lat from (" + fixture.FX + " select event_id, lat, lon from fx)")
def tile_place_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to shares of tiles of zoom 15 and back, on both axes."""
    n, r = 1 << 15, F.radians("lat")
    x, y = (F.col("lon") + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * n
    back = fixture.fixes(spark, sf_dir).withColumns({"tx": x, "ty": y})
    return back.select("event_id", F.round(basemap.lon_of_tile(F.col("tx"), F.lit(15)), 6).alias("lon"), F.round(basemap.lat_of_tile(F.col("ty"), F.lit(15)), 6).alias("lat"))
