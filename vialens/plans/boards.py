"""Queries that riders ask: lines near a point, searches, timetables, what is coming, place names, display texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import display, geo
from vialens.operators import addresses, schedule, spatial
from vialens.operators.stored import stored
from vialens.plans import fixture
from vialens.plans.fixture import FX, LATEST_SQL, LATEST_STANDING_SQL, SHAPES_SQL
from vialens.plans.fleet import ON_ROAD, on_road
from vialens.plans.registry import query, table
from vialens.plans.rider import STOPS_SQL, stops_with_lines
from vialens.plans.schedule import RATES_SQL, hourly_rates

HERE = (-22.922, -43.4)
NEAR_SQL = "with " + STOPS_SQL + f""", d as (select lines as line, 12742000.0 * asin(sqrt(power(sin(radians(lat - {HERE[0]}) / 2), 2) + cos(radians({HERE[0]})) * cos(radians(lat)) * power(sin(radians(lon - {HERE[1]}) / 2), 2))) as metres from p),
near as (select line, round(min(metres), 2) as metres from d where metres <= 2500 group by line)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = geo.haversine(F.lit(HERE[0]), F.lit(HERE[1]), F.col("lat"), F.col("lon"))
    return stops_with_lines(spark, sf_dir).withColumn("metres", d).where("metres <= 2500").groupBy(F.col("lines").alias("line")).agg(F.round(F.min("metres"), 2).alias("metres"))


@query(NEAR_SQL + " select line, metres from near")
def nearby_lines_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a stop near a point, and the least distance."""
    return _near(spark, sf_dir)


@query(RATES_SQL + "," + NEAR_SQL.removeprefix("with ") + """, h as (select n_name as line, min(minutes) as headway from mins join customer on mins.line = concat('c', c_custkey) join nation on n_nationkey = c_nationkey where svc = 0 and hour = 8 group by 1)
  select line, metres, round(metres / 75.0 + coalesce(headway / 2.0, 1000.0), 3) as cost from near left join h using (line)""")
def nearby_lines_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near a point by the minutes to board one on a working day at eight; a line's customers are its shapes."""
    of = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("line"), F.col("c_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation"), "n_nationkey")
    h = hourly_rates(spark, sf_dir).withColumn("minutes", schedule.headway_minutes(F.col("rate"))).where("svc = 0 and hour = 8")
    h = h.join(of, "line").groupBy(F.col("n_name").alias("line")).agg(F.min("minutes").alias("headway"))
    rows = _near(spark, sf_dir).join(h, "line", "left")
    return rows.select("line", "metres", F.round(display.boarding_cost(F.col("metres"), F.col("headway")), 3).alias("cost")).orderBy("cost", "line")


@query(NEAR_SQL + " select line from near where line not in (select n_name from nation where n_regionkey = 1)")
def nearby_minus_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines near a point without those that are followed: here those of one region."""
    followed = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("line"))
    return _near(spark, sf_dir).select("line").join(followed, "line", "left_anti")


@query("with t as (select p_partkey, p_name, p_brand, case when lower(p_brand) like 'brand#1%' then 0 when contains(lower(p_name), 'ring') then 1 end as kind from part) select p_partkey, p_name, kind from t where kind is not null order by kind, p_partkey limit 30")
def line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that start with what was typed, then names that contain it; the first 30."""
    kind = F.when(F.lower("p_brand").startswith("brand#1"), 0).when(F.lower("p_name").contains("ring"), 1)
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", kind.alias("kind")).where("kind is not null").orderBy("kind", "p_partkey").limit(30)


@query("with n as (select distinct p_name as name from part) select name, cast(levenshtein(name, 'red gizma') as int) as d from n where levenshtein(name, 'red gizma') <= 2 order by d, length(name), name limit 3")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within two edits of what was typed, nearest and shortest first."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    d = F.levenshtein("name", F.lit("red gizma"), 2)
    return names.withColumn("d", d).where("d >= 0").orderBy("d", F.length("name"), "name").limit(3)


@query("with n as (select 'Praça ' || n_name || case when n_nationkey % 2 = 0 then ' São' else ' ÁGUA' end as name, n_nationkey as k from nation) select name, k from n where contains(strip_accents(lower(name)), 'agua') order by case when starts_with(strip_accents(lower(name)), 'praca a') then 0 else 1 end, k limit 6")
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose names contain what was typed, accents and case aside; those that start with it first, six at most."""
    name = F.concat(F.lit("Praça "), "n_name", F.expr("case when n_nationkey % 2 = 0 then ' São' else ' ÁGUA' end"))
    rows = table(spark, sf_dir, "nation").select(name.alias("name"), F.col("n_nationkey").alias("k"))
    key = F.collate("name", "UNICODE_CI_AI")
    return rows.where(F.contains(key, F.collate(F.lit("agua"), "UNICODE_CI_AI"))).orderBy(F.when(F.startswith(key, F.collate(F.lit("praca a"), "UNICODE_CI_AI")), 0).otherwise(1), "k").limit(6)


@query("with j as (select s_suppkey, case when s_suppkey % 3 = 0 then '' else s_name end as nm, 'Rua ' || s_suppkey as road, cast(s_suppkey % 7 as varchar) as num from supplier) select s_suppkey, case when nm <> '' then nm else road || ', ' || num end as name, 'Centro' as area, -22.9 + s_suppkey / 100000.0 as lat from j")
def geocode_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places from a geocoder's JSON: their own name, else street and number; the first area given."""
    s = table(spark, sf_dir, "supplier")
    body = F.to_json(F.struct(F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name")).alias("name"), (F.lit(-22.9) + F.col("s_suppkey") / 100000.0).alias("lat"), F.create_map(F.lit("road"), F.concat(F.lit("Rua "), "s_suppkey"), F.lit("house_number"), (F.col("s_suppkey") % 7).cast("string"), F.lit("suburb"), F.lit(""), F.lit("city_district"), F.lit("Centro")).alias("address")))
    at = lambda p: F.nullif(F.get_json_object(body, p), F.lit(""))
    name = F.coalesce(at("$.name"), F.concat_ws(", ", at("$.address.road"), at("$.address.house_number")))
    area = F.coalesce(at("$.address.suburb"), at("$.address.neighbourhood"), at("$.address.city_district"), at("$.address.city"))
    return s.select("s_suppkey", name.alias("name"), area.alias("area"), F.get_json_object(body, "$.lat").try_cast("double").alias("lat"))


@query("""with e as (select event_id, (event_id * 37) % 4000 as m, event_id % 500 as s, event_id % 3 as live, case when event_id % 4 = 0 then null else event_id % 30 + 1 end as h, case when event_id % 8 = 0 then null else event_id % 24 end as nh from events)
  select event_id, case when m >= 1000 then replace(printf('%.1f', m / 1000), '.', ',') || ' km' else m || ' m' end as metres, greatest(1, cast(round(m / 75) as bigint)) || ' min' as walk, (s // 60) || ':' || lpad(cast(s % 60 as varchar), 2, '0') || ' atrás' as age,
  case when live > 0 then live || ' buses live' when h is not null then 'every ' || h || ' min, none live' when nh is not null then 'starts at ' || lpad(cast(nh as varchar), 2, '0') || ':00' else 'no service today' end as state from e where m % 100 <> 50""")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "event_id * 37 % 4000 as m", "event_id % 500 as s", "event_id % 3 as live", "case when event_id % 4 = 0 then null else event_id % 30 + 1 end as h", "case when event_id % 8 = 0 then null else event_id % 24 end as nh").where("m % 100 <> 50")
    return e.select("event_id", display.metres_text(F.col("m")).alias("metres"), display.walk_text(F.col("m")).alias("walk"), display.age_text(F.col("s")).alias("age"), display.line_state(F.col("live"), F.col("h"), F.col("nh")).alias("state"))


@query("with t as (select p_partkey, '  ' || upper(p_name) || '   -  ' || p_brand || ' ' as t from part) select p_partkey, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) as key, regexp_replace(t, '\\s+-\\s+', ' x ', 'g') as shown, url_encode(t || '~*é') as url, regexp_extract('Rua A ' || p_partkey, '(\\d+)', 1) as number from t")
def line_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   -  "), "p_brand", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", display.search_key(t).alias("key"), display.route_name(t).alias("shown"), display.url_encoded(F.concat(t, F.lit("~*é"))).alias("url"), display.house_number(F.concat(F.lit("Rua A "), "p_partkey")).alias("number"))


@query(FX + "," + LATEST_SQL + "," + STOPS_SQL + """, st as (select stop_id, (lon - -43.4) * 102431.14359791845 as x, (lat - -22.9) * 111194.92664455873 as y from p),
  pl as (select p_name as name, p_partkey as k, (p_partkey * 29 % 300) * 100.0 - 8000 as x, (p_partkey * 17 % 90) * 100.0 - 3000 as y from part),
  a as (select vehicle, stop_id, sqrt(power(s.x - l.x, 2) + power(s.y - l.y, 2)) as m from latest l, st s qualify row_number() over (partition by vehicle order by m, stop_id) = 1),
  b as (select vehicle, name, sqrt(power(s.x - l.x, 2) + power(s.y - l.y, 2)) as m from latest l, pl s qualify row_number() over (partition by vehicle order by m, name) = 1)
  select a.vehicle, case when a.m <= 250 then stop_id when b.m < 3000 then name else 'somewhere' end as name from a join b using (vehicle)""")
def nearby_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to call a place: its nearest stop if within 250 m, else the nearest named place within 3 km, else a default."""
    rows = stored(fixture.latest(fixture.fixes(spark, sf_dir)).select("vehicle", "x", "y"), "latest")
    stops = stops_with_lines(spark, sf_dir).select("stop_id", geo.x_of(F.col("lon")).alias("x"), geo.y_of(F.col("lat")).alias("y"))
    k = F.col("p_partkey")
    places = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), ((k * 29 % 300) * 100.0 - 8000).alias("x"), ((k * 17 % 90) * 100.0 - 3000).alias("y"))
    stop = spatial.nearest_by_rings(rows, stops, "vehicle", "stop_id", 250.0).withColumnRenamed("metres", "stop_m")
    place = spatial.nearest_by_rings(rows, places, "vehicle", "name", 1000.0)
    held = rows.select("vehicle").join(stop, "vehicle", "left").join(place, "vehicle", "left")
    return held.select("vehicle", F.when(F.col("stop_m") <= 250, F.col("stop_id")).when(F.col("metres") < 3000, F.col("name")).otherwise("somewhere").alias("name"))


@query(FX + "," + LATEST_STANDING_SQL + ", " + "shown as (select *, case when seen_at - t > 180 then 'stale' when standing then 'parked' else 'live' end as phase from latest), i as (select * from shown where phase = 'live') select vehicle, service, cast(row_number() over (partition by service order by t desc, vehicle) as int) as place from i qualify row_number() over (partition by service order by t desc, vehicle) <= 3")
def incoming_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest moving vehicles of each line that a map shows; parked and stale ones are hidden."""
    rows = fixture.latest_standing(fixture.fixes(spark, sf_dir)).where("seen_at - t <= 180 and not standing")
    place = F.row_number().over(Window.partitionBy("service").orderBy(F.desc("t"), "vehicle"))
    return rows.withColumn("place", place).where("place <= 3").select("vehicle", "service", "place")


@query(ON_ROAD + "," + SHAPES_SQL + """, c as (select vehicle, sentido, case sentido when 'ida' then 0 when 'volta' then 1 end as want, route_ix as road from resolved),
  a as (select c.vehicle, s.shape_id, want is null or s.direction = want as preferred from c join shp s on s.route_ix = road) select vehicle, string_agg(shape_id, ',' order by shape_id) filter (where preferred) as preferred, string_agg(shape_id, ',' order by shape_id) as every from a group by vehicle""")
def candidate_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shapes of a vehicle's route in the direction that it reports, and all of them to fall back on."""
    rows = on_road(spark, sf_dir).withColumn("want", F.expr("case sentido when 'ida' then 0 when 'volta' then 1 end"))
    held = fixture.shapes(spark).groupBy("route_ix").agg(F.array_sort(F.collect_list(F.struct("shape_id", "direction"))).alias("s"))
    j = rows.join(F.broadcast(held), "route_ix")
    some = F.filter("s", lambda s: F.col("want").isNull() | (s["direction"] == F.col("want")))
    names = lambda c: F.array_join(F.transform(c, lambda s: s["shape_id"]), ",")
    return j.select("vehicle", names(some).alias("preferred"), names(F.col("s")).alias("every"))


@query(ON_ROAD + "," + SHAPES_SQL + """, d as (select vehicle, direction, min(round(sqrt(power(s.x - l.x, 2) + power(s.y - l.y, 2)), 2)) as m from resolved l join stp s on s.route_ix = l.route_ix group by all)
  select vehicle, coalesce(max(case sentido when 'ida' then 0 when 'volta' then 1 end), cast(first(direction order by m, direction) as int)) as direction from d join latest using (vehicle) group by vehicle""")
def current_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction chosen, else that with the nearest stop."""
    rows = on_road(spark, sf_dir)
    stops = fixture.stops(spark).select("route_ix", "direction", F.col("x").alias("sx"), F.col("y").alias("sy"))
    j = rows.join(F.broadcast(stops), "route_ix")
    m = F.round(geo.distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")), 2)
    near = j.groupBy("vehicle", "sentido").agg(F.min(F.struct(m.alias("m"), "direction")).alias("b"))
    return near.select("vehicle", F.coalesce(F.expr("case sentido when 'ida' then 0 when 'volta' then 1 end"), F.col("b.direction")).alias("direction"))


@query(RATES_SQL + """, k as (select distinct concat('s', l_suppkey) as stop_id, concat('c', o_custkey) as line from lineitem join orders on o_orderkey = l_orderkey)
  select stop_id, line, svc, string_agg(from_hour || '-' || to_hour || '/' || minutes, ' ' order by from_hour) as runs from runs join k using (line) group by all""")
def stop_timetable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headways of each line at each stop by day type: suppliers as stops of the customers that order from them."""
    h = schedule.runs(hourly_rates(spark, sf_dir).withColumn("minutes", schedule.headway_minutes(F.col("rate"))))
    text = F.concat("from_hour", F.lit("-"), "to_hour", F.lit("/"), "minutes")
    per = h.groupBy("line", "svc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from_hour", text.alias("t")))), lambda x: x["t"]), " ").alias("runs"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), "l_suppkey").alias("stop_id")).join(table(spark, sf_dir, "orders"), "o_orderkey")
    return calls.select("stop_id", F.concat(F.lit("c"), "o_custkey").alias("line")).distinct().join(per, "line").select("stop_id", "line", "svc", "runs")


@query("with c as (select p_partkey, p_brand, p_size % 8 as colour from part) select p_partkey, n as over_ from c join (select colour, count(distinct p_brand) as n from c group by colour) using (colour)")
def colour_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines share a colour: over one, and a number has to tell them apart."""
    c = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 8).alias("colour"))
    return c.join(F.broadcast(c.groupBy("colour").agg(F.countDistinct("p_brand").alias("over_"))), "colour").select("p_partkey", "over_")


@query(FX + """, a as (select 'r:' || printf('%.4f', lat) || ',' || printf('%.4f', lon) as key, t as told, vehicle || '-' || event_id as place from fx where event_id % 3 = 0),
  n as (select key, max(told) as told, last(place order by told, place) as place from a group by key), c as (select max(t) - 3600 + 86400 as now from fx),
  q as (select event_id, 'r:' || printf('%.4f', lat) || ',' || printf('%.4f', lon) as key from fx where event_id % 3 <> 0)
  select event_id, key, case when now - told < 86400 then place end as place, not coalesce(now - told < 86400, false) as asked from q left join n using (key), c""")
def reverse_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose address was asked for, by the key that places 11 m apart share: answers younger than a day, and what is to be fetched."""
    fx = fixture.fixes(spark, sf_dir).withColumn("key", display.reverse_lookup(F.col("lat"), F.col("lon")))
    kept = fx.where("event_id % 3 = 0").select("key", F.col("t").alias("at"), F.concat_ws("-", "vehicle", "event_id").alias("place"))
    answers = kept.groupBy("key", "at").agg(F.max("place").alias("places"))
    now = (fx.agg(F.max("t")).first()[0] or 0) - 3600 + addresses.TTL_S
    return addresses.looked_up(fx.where("event_id % 3 <> 0").select("event_id", "key"), answers, now).select("event_id", "key", F.col("places").alias("place"), "asked")


@query("""with w as (select p_partkey, string_split(p_name, ' ')[1] as word, p_partkey * 7 % 1500 as x from part), a as (select 's:' || lower(word) as key, count(*) as n, min(p_partkey) as first from w where p_partkey % 2 = 0 and length(word) >= 3 group by 1),
  q as (select p_partkey, case when length(word) >= 3 then 's:' || lower(word) end as key from (select p_partkey, case when p_partkey % 11 = 0 then substr(word, 1, 2) else word end as word from w))
  select p_partkey, key, n, first, key is not null and n is null as asked from q left join a using (key)""")
def address_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed searches by their normalised key: kept answers, here of parts by the first word of their name, and what is to be fetched."""
    word = F.get(F.split("p_name", " "), F.lit(0))
    rows = table(spark, sf_dir, "part").withColumn("word", word)
    answers = rows.where("p_partkey % 2 = 0").groupBy(display.search_lookup(F.col("word")).alias("key")).agg(F.struct(F.count("*").alias("n"), F.min("p_partkey").alias("first")).alias("places")).where("key is not null").withColumn("at", F.lit(0))
    typed = F.concat(F.lit("  "), F.upper(F.when(F.col("p_partkey") % 11 == 0, F.substring("word", 1, 2)).otherwise(F.col("word"))), F.lit(" "))
    got = addresses.looked_up(rows.select("p_partkey", display.search_lookup(typed).alias("key")), answers, 60)
    return got.select("p_partkey", "key", F.col("places.n").alias("n"), F.col("places.first").alias("first"), "asked")
