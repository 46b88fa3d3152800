"""Queries on fixes: hygiene, services, lines, duplicates, motion, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import codes, geo, times
from vialens.operators import hygiene, lookups
from vialens.plans import fixture
from vialens.plans.fixture import FX, LATEST_SQL, LATEST_STANDING_SQL, ROUTES_SQL
from vialens.plans.registry import query, table

RESOLVED_SQL = """
named as (select short_name as name, route_ix, short_name as line from routes union all select alias, route_ix, short_name from aliases join routes on target = short_name),
resolved as (select l.*, coalesce(a.route_ix, b.route_ix, c.route_ix) as route_ix, coalesce(a.line, b.line, c.line) as line from {src} l
  left join named a on a.name = trim(service) left join named b on b.name = ltrim(trim(service), '0')
  left join named c on c.name = case when length(ltrim(trim(service), '0')) < 3 then lpad(ltrim(trim(service), '0'), 3, '0') else ltrim(trim(service), '0') end)"""
STATE_SQL = """case when trim(coalesce(service, '')) = '' then 'unknown' when regexp_matches(trim(service), '^0+$') or trim(service) in ('GARAGEM', 'RESERVADO')
  or regexp_matches(trim(service), '(^|[^A-Z0-9])GAR($|[^A-Z0-9])') then 'out' else 'named' end"""
ON_ROAD = FX + ", " + ROUTES_SQL + "," + LATEST_SQL + "," + RESOLVED_SQL.format(src="latest")

STANDING = FX + ", " + ROUTES_SQL + "," + LATEST_STANDING_SQL + "," + RESOLVED_SQL.format(src="latest")


def on_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vehicle's newest good fix with its route and the name shown for its line."""
    rows = lookups.resolve_service(fixture.latest(fixture.fixes(spark, sf_dir)), fixture.routes(spark), fixture.aliases(spark))
    return rows.withColumn("shown", F.coalesce("line", "service"))


@query(ON_ROAD + " select coalesce(line, service) as line, count(*) as buses, cast(max(case when route_ix is null then 0 else 1 end) as int) as has_route from resolved group by coalesce(line, service)")
def live_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles on the road a line, and whether its route is known; most first."""
    rows = on_road(spark, sf_dir).groupBy(F.col("shown").alias("line")).agg(F.count("*").alias("buses"), F.max(F.col("route_ix").isNotNull().cast("int")).alias("has_route"))
    return rows.orderBy(F.desc("buses"), "line")


@query(ON_ROAD + " select coalesce(line, service) as line, count(*) as n from resolved group by coalesce(line, service)")
def vehicles_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_road(spark, sf_dir).groupBy(F.col("shown").alias("line")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "line")


@query(STANDING + """, p as (select case when 1800000000 + 20 * (select max(event_id) // 40 from events) - t > 180 then 'stale' when standing then 'parked' else 'live' end as phase
  from resolved) select phase, count(*) as n from p group by phase""")
def phase_like_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles by a phase judged from age and movement alone."""
    now = table(spark, sf_dir, "events").agg((F.lit(1800000000) + 20 * F.expr("max(event_id) div 40")).alias("now"))
    phase = F.when(F.col("now") - F.col("t") > 180, "stale").when(F.col("standing"), "parked").otherwise("live")
    return fixture.latest_standing(fixture.fixes(spark, sf_dir)).join(F.broadcast(now)).groupBy(phase.alias("phase")).agg(F.count("*").alias("n"))


@query(FX + """ select outcome, count(*) as n from (select case when not (lat between -23.15 and -22.65 and lon between -43.9 and -43.0) then 'outside' when t > seen_at + 60 then 'future'
  when service = 'GARAGEM' then 'out_of_service' when seen_at - t > 300 then 'too_old' else 'pass' end as outcome from fx) group by outcome""")
def hygiene_outcomes_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.fixes(spark, sf_dir).groupBy(hygiene.stateless_outcome(["3"]).alias("outcome")).agg(F.count("*").alias("n"))


@query(FX + """ , r as (select * from fx union all select * replace (seen_at + 1 as seen_at) from fx where event_id % 50 = 0)
  select vehicle, vendor, t, event_id, seen_at from (select *, row_number() over (partition by vehicle, vendor, t order by seen_at, event_id) as rn from r) where rn = 1""")
def dedupe_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.repeated_fixes(fixture.fixes(spark, sf_dir))
    return hygiene.first_reports(rows, "event_id").select("vehicle", "vendor", "t", "event_id", "seen_at")


@query("""with r as (select event_id, concat(case when event_id % 2 = 0 then ' ' else '' end, case event_id % 7 when 0 then 'Zirix' when 1 then 'CONECTA' when 2 then 'maxtrack ' when 3 then 'Sonda' when 4 then 'x' else event_type end) as v,
  case event_id % 11 when 0 then 'I' when 1 then 'ida' when 2 then '0' when 3 then 'V' when 4 then 'Volta ' when 5 then '1' when 6 then 'C' when 7 then 'Único' when 8 then 'circular' when 9 then '' end as s from events)
  select vendor, direction, count(*) as n from (select case when lower(trim(v)) in ('zirix', 'conecta', 'maxtrack', 'sonda') then lower(trim(v)) else 'unknown' end as vendor,
  case when lower(trim(s)) in ('i', 'ida', '0') then 'ida' when lower(trim(s)) in ('v', 'volta', '1') then 'volta' when lower(trim(s)) in ('c', 'circular', 'unico', 'único') then 'circular' end as direction from r) group by all""")
def vendor_direction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("concat(case when event_id % 2 = 0 then ' ' else '' end, case event_id % 7 when 0 then 'Zirix' when 1 then 'CONECTA' when 2 then 'maxtrack ' when 3 then 'Sonda' when 4 then 'x' else event_type end)")
    s = F.expr("case event_id % 11 when 0 then 'I' when 1 then 'ida' when 2 then '0' when 3 then 'V' when 4 then 'Volta ' when 5 then '1' when 6 then 'C' when 7 then 'Único' when 8 then 'circular' when 9 then '' end")
    return table(spark, sf_dir, "events").groupBy(codes.vendor(v).alias("vendor"), codes.direction(s).alias("direction")).agg(F.count("*").alias("n"))


CODES = ["474", "0", "000", " ", "1 GAR", "GAR 2", "garagem", "GARAGE7", "MANGAR", "Manutenção", "recolhe", "treino", "SEM LINHA", "LECD140", "7", "Fora de Op", "3A", "GAR-9"]


@query(f"""with c as (select event_id, {CODES}[event_id % {len(CODES)} + 1] || case when event_id % 5 = 0 then ' ' || event_id % 7 else '' end as code from events) select event_id, code, case when trim(code) = '' then 'unknown' when regexp_matches(trim(code), '^0+$') or upper(trim(code)) in ('GARAGEM', 'MANUTENÇÃO', 'RECOLHE', 'TREINO', 'SEM LINHA', 'FORA DE OP')
  or len(list_filter(string_split_regex(upper(trim(code)), '[^A-Z0-9]'), lambda x: x = 'GAR' or starts_with(x, 'GARAG'))) > 0 then 'out' else 'named' end as state, starts_with(code, 'LECD') as provisional from c""")
def service_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    code = F.concat(F.get(F.array(*map(F.lit, CODES)), (k % len(CODES)).cast("int")), F.when(k % 5 == 0, F.concat(F.lit(" "), k % 7)).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", code.alias("code")).select("event_id", "code", codes.service_state(F.col("code")).alias("state"), codes.is_provisional(F.col("code")).alias("provisional"))


@query(FX + ", " + ROUTES_SQL + "," + RESOLVED_SQL.format(src="fx") + " select service, line, route_ix, count(*) as n from resolved group by all")
def service_to_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.resolve_service(fixture.fixes(spark, sf_dir), fixture.routes(spark), fixture.aliases(spark))
    return rows.groupBy("service", "line", "route_ix").agg(F.count("*").alias("n"))


@query("""with m as (select event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case event_id % 4 when 0 then 'Z' when 1 then '' when 2 then '-03:00' else '.250+02:00' end as s from events)
  select event_id, cast(epoch(date_trunc('second', ts)) as bigint) + case event_id % 4 when 2 then 10800 when 3 then -7200 else 0 end as seconds from m""")
def iso_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.expr("case event_id % 4 when 0 then 'Z' when 1 then '' when 2 then '-03:00' else '.250+02:00' end")).alias("s"))
    return rows.select("event_id", times.parse_iso(F.col("s")).cast("long").alias("seconds"))


@query(FX + " select strftime(to_timestamp(t - t % 60), '%Y-%m-%dT%H:%M:%SZ') as minute, count(*) as n, count(distinct vehicle) as vehicles from fx group by 1")
def minute_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.fixes(spark, sf_dir).groupBy(times.minute_text(F.col("t")).alias("minute")).agg(F.count("*").alias("n"), F.countDistinct("vehicle").alias("vehicles"))


@query(FX + """ select event_id, round((lon - -43.4) * 102431.14359791845, 3) + 0 as x, round((lat - -22.9) * 111194.92664455873, 3) + 0 as y,
  round(sqrt(power((lon - -43.4) * 102431.14359791845 - 6000, 2) + power((lat - -22.9) * 111194.92664455873 - 120, 2)), 3) as to_yard from fx""")
def project_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.x_of(F.col("lon")), geo.y_of(F.col("lat"))
    return fixture.fixes(spark, sf_dir).select("event_id", (F.round(x, 3) + 0).alias("x"), (F.round(y, 3) + 0).alias("y"), F.round(geo.distance(x, y, F.lit(6000.0), F.lit(120.0)), 3).alias("to_yard"))


@query(FX + """ select cast(greatest(0, least(8191, floor((lon + 180) / 360 * 8192))) as int) as tile_x,
  cast(greatest(0, least(8191, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8192))) as int) as tile_y, count(*) as n from fx group by 1, 2""")
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.fixes(spark, sf_dir).groupBy(geo.tile_x(F.col("lon"), 13).alias("tile_x"), geo.tile_y(F.col("lat"), 13).alias("tile_y")).agg(F.count("*").alias("n"))


PREV = FX + "," + LATEST_SQL.split("latest as")[0].rstrip().rstrip(",")


@query(PREV + """ select event_id, t - lag(t) over w as dt, round(sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)), 3) as metres,
  round((degrees(atan2(x - lag(x) over w, y - lag(y) over w)) + 360) % 360, 3) as bearing from good window w as (partition by vehicle order by t, event_id)""")
def prev_fix_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hygiene.with_previous(fixture.good_fixes(fixture.fixes(spark, sf_dir)), ["vehicle"], ["t", "event_id"])
    x, y, px, py = map(F.col, ("x", "y", "prev_x", "prev_y"))
    return rows.select("event_id", (F.col("t") - F.col("prev_t")).alias("dt"), F.round(geo.distance(px, py, x, y), 3).alias("metres"), F.round(geo.bearing(px, py, x, y), 3).alias("bearing"))


@query(PREV + """ , l as (select *, t - lag(t) over w as dt, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) as d from good window w as (partition by vehicle, vendor order by t, event_id))
  select vendor, count(*) filter (where dt > 0 and d / dt > 27) as jumps, count(*) as n from l group by vendor""")
def same_unit_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps faster than 27 m/s against the same unit's fix before; the stateful gate compares with the last accepted one."""
    rows = hygiene.with_previous(fixture.good_fixes(fixture.fixes(spark, sf_dir)), ["vehicle", "vendor"], ["t", "event_id"])
    dt = F.col("t") - F.col("prev_t")
    d = geo.distance(F.col("prev_x"), F.col("prev_y"), F.col("x"), F.col("y"))
    return rows.groupBy("vendor").agg(F.count_if((dt > 0) & (d / dt > 27)).alias("jumps"), F.count("*").alias("n"))


@query(FX + """ select vendor, count(*) as n, list_sort(list(age))[greatest(1, least(count(*), cast(floor(count(*) * 0.1) as bigint) + 1))] as p10, list_sort(list(age))[least(count(*), cast(floor(count(*) * 0.5) as bigint) + 1)] as p50,
  list_sort(list(age))[least(count(*), cast(floor(count(*) * 0.9) as bigint) + 1)] as p90, list_sort(list(age))[least(count(*), cast(floor(count(*) * 0.99) as bigint) + 1)] as p99 from (select vendor, seen_at - t as age from fx) group by vendor""")
def age_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor-rank percentiles: the element at floor(n p), n - 1 at most. Equal ages are counted first, so no array of all rows is built."""
    ages = fixture.fixes(spark, sf_dir).groupBy("vendor", (F.col("seen_at") - F.col("t")).alias("age")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("vendor").orderBy("age")
    upto = ages.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("vendor")))
    rank = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    return upto.groupBy("vendor").agg(F.max("n").alias("n"), *(F.min(F.when(F.col("upto") > rank(p), F.col("age"))).alias(name) for name, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99))))


@query(FX + " select vendor, count(*) as rows, count(distinct vehicle) as vehicles, count(*) filter (where seen_at - t <= 300) as fresh, max(t) as newest, max(t % 60) as last_second from fx group by vendor")
def feed_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.fixes(spark, sf_dir).groupBy("vendor")
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("vehicle").alias("vehicles"), F.count_if(F.col("seen_at") - F.col("t") <= 300).alias("fresh"), F.max("t").alias("newest"), F.max(F.pmod("t", F.lit(60))).alias("last_second"))


@query(FX + ", " + ROUTES_SQL + "," + RESOLVED_SQL.format(src="fx") + " select service, count(*) as n from resolved where route_ix is null and service is not null group by service order by n desc, service limit 20")
def topk_unknown_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.resolve_service(fixture.fixes(spark, sf_dir), fixture.routes(spark), fixture.aliases(spark))
    return rows.where("route_ix is null and service is not null").groupBy("service").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "service").limit(20)


@query(FX + ", " + ROUTES_SQL + "," + RESOLVED_SQL.format(src="fx") + """, c as (select vendor, coalesce(line, service) as line, count(*) as n from resolved where service is not null group by all)
  select vendor, line, n, cast(round(100.0 * n / total) as bigint) as pct from (select *, sum(n) over (partition by vendor) as total, row_number() over (partition by vendor order by n desc, line) as rn from c) where rn <= 2""")
def top2_routes_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookups.resolve_service(fixture.fixes(spark, sf_dir).where("service is not null"), fixture.routes(spark), fixture.aliases(spark))
    c = rows.groupBy("vendor", F.coalesce("line", "service").alias("line")).agg(F.count("*").alias("n"))
    ranked = c.withColumn("total", F.sum("n").over(Window.partitionBy("vendor"))).withColumn("rn", F.row_number().over(Window.partitionBy("vendor").orderBy(F.desc("n"), "line")))
    return ranked.where("rn <= 2").select("vendor", "line", "n", F.round(100.0 * F.col("n") / F.col("total")).cast("long").alias("pct"))


@query(FX + " select vehicle, vendor, t from fx where event_id % 2 = 0 union all select vehicle, 'sonda' as vendor, t from fx where event_id % 3 = 0")
def union_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feeds as one bag of fixes."""
    fx = fixture.fixes(spark, sf_dir).select("event_id", "vehicle", "vendor", "t")
    return fx.where("event_id % 2 = 0").drop("event_id").unionByName(fx.where("event_id % 3 = 0").drop("event_id").withColumn("vendor", F.lit("sonda")))


@query(ON_ROAD + " select distinct coalesce(line, service) as line from resolved where coalesce(line, service) not in (select short_name from routes)")
def lines_without_route_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_road(spark, sf_dir).select(F.col("shown").alias("line")).distinct().join(F.broadcast(fixture.routes(spark).select(F.col("short_name").alias("line"))), "line", "left_anti")


@query(ON_ROAD + " select short_name as line from routes union select coalesce(line, service) from resolved")
def known_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.routes(spark).select(F.col("short_name").alias("line")).union(on_road(spark, sf_dir).select("shown")).distinct()


@query(ON_ROAD + """, g as (select coalesce(line, service) as line, count(*) as n, string_agg(vehicle, ',' order by vehicle) as vehicles from resolved group by 1)
  select r.short_name as line, coalesce(g.n, 0) as n, coalesce(g.vehicles, '') as vehicles from (select short_name from routes union all select '999') r left join g on g.line = r.short_name""")
def dense_lines_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known line with its vehicles in order, empty lines included."""
    keys = fixture.routes(spark).select(F.col("short_name").alias("line")).union(spark.createDataFrame([("999",)], "line string"))
    grouped = on_road(spark, sf_dir).groupBy(F.col("shown").alias("line")).agg(F.array_sort(F.collect_list("vehicle")).alias("v"))
    rows = lookups.dense(keys, grouped, "line", "v")
    return rows.select("line", F.size("v").cast("long").alias("n"), F.array_join("v", ",").alias("vehicles"))


@query(ON_ROAD + """, s as (select *, cast(greatest(0, least(2047, floor((lon + 180) / 360 * 2048))) as int) as tile_x, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2048) as int) as tile_y from latest),
  tiles as (select a as tile_x, b as tile_y from range(774, 780) x(a), range(1158, 1162) y(b))
  select tiles.tile_x, tiles.tile_y, count(vehicle) as n, coalesce(string_agg(vehicle, ',' order by vehicle), '') as vehicles from tiles left join s using (tile_x, tile_y) group by all""")
def dense_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = spark.range(774, 780).select(F.col("id").cast("int").alias("tile_x")).withColumn("tile_y", F.explode(F.sequence(F.lit(1158), F.lit(1161))))
    rows = fixture.latest(fixture.fixes(spark, sf_dir)).select("vehicle", geo.tile_x(F.col("lon"), 11).alias("tile_x"), geo.tile_y(F.col("lat"), 11).alias("tile_y"))
    grouped = rows.groupBy("tile_x", "tile_y").agg(F.array_sort(F.collect_list("vehicle")).alias("v"))
    return tiles.join(grouped, ["tile_x", "tile_y"], "left").select("tile_x", "tile_y", F.coalesce(F.size("v"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join("v", ","), F.lit("")).alias("vehicles"))


@query(FX + """, j as (select *, row_number() over (partition by vendor order by event_id desc) as rn, max(t) over (partition by vendor) as newest, count(*) over (partition by vendor) as rows from fx)
  select vendor, event_id as last_event, newest, rows, case when 1900000000 - newest > 120 then 'stale' else 'ok' end as state from j where rn = 1""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest report of each source, its newest fix and rows, and whether it is stale at a stated clock."""
    rows = fixture.fixes(spark, sf_dir).groupBy("vendor").agg(F.max("event_id").alias("last_event"), F.max("t").alias("newest"), F.count("*").alias("rows"))
    return rows.withColumn("state", F.when(1900000000 - F.col("newest") > 120, "stale").otherwise("ok"))


@query(FX + " select * from (select max(t) as newest, count(*) as rows from fx)")
def newest_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.fixes(spark, sf_dir).agg(F.coalesce(F.max("t"), F.lit(0)).alias("newest"), F.count("*").alias("rows"))


@query(STANDING + """, s as (select *, standing as yard, 1800000000 + 20 * (select max(event_id) // 40 from events) - t > 180 as stale from resolved)
  select count(*) as tracked, count(*) filter (where route_ix is not null) as routed, count(*) filter (where route_ix is not null and not yard and not stale) as in_service,
  cast(case when count(*) filter (where route_ix is not null and not yard and not stale) = 0 then 0 else least(count(*) filter (where heading is not null), count(*) filter (where route_ix is not null and not yard and not stale)) * 100 // count(*) filter (where route_ix is not null and not yard and not stale) end as bigint) as rate_pct from s""")
def in_service_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg((F.lit(1800000000) + 20 * F.expr("max(event_id) div 40")).alias("now"))
    rows = lookups.resolve_service(fixture.latest_standing(fixture.fixes(spark, sf_dir)), fixture.routes(spark), fixture.aliases(spark)).join(F.broadcast(now))
    ok = F.col("route_ix").isNotNull() & ~F.col("standing") & (F.col("now") - F.col("t") <= 180)
    c = rows.agg(F.count("*").alias("tracked"), F.count("route_ix").alias("routed"), F.count_if(ok).alias("in_service"), F.count("heading").alias("seen"))
    return c.select("tracked", "routed", "in_service", F.expr("cast(case when in_service = 0 then 0 else least(seen, in_service) * 100 div in_service end as bigint)").alias("rate_pct"))


@query(FX + """, e as (select vehicle, to_json({'id': vehicle, 'n': count(*), 'newest': max(t)}) as body from fx group by vehicle) select vehicle, body from e""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixture.fixes(spark, sf_dir).groupBy("vehicle").agg(F.count("*").alias("n"), F.max("t").alias("newest"))
    return rows.select("vehicle", F.to_json(F.struct(F.col("vehicle").alias("id"), "n", "newest")).alias("body"))


@query(FX + """, a as (select vehicle, count(*) as n from fx where event_id % 3 = 0 group by vehicle), b as (select vehicle, count(*) as n from fx group by vehicle)
  select b.vehicle from b left join a using (vehicle) where a.n is null or a.n <> b.n union all select vehicle from a where vehicle not in (select vehicle from b)""")
def changed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose documents differ from the last ones written, by their bodies' hashes."""
    body = lambda d: d.groupBy("vehicle").agg(F.count("*").alias("n")).select("vehicle", F.xxhash64("n").alias("h"))
    fx = fixture.fixes(spark, sf_dir)
    old, new = body(fx.where("event_id % 3 = 0")).withColumnRenamed("h", "old"), body(fx)
    return new.join(old, "vehicle", "full").where("old is distinct from h").select("vehicle")


@query(FX + ", " + ROUTES_SQL + "," + RESOLVED_SQL.format(src="fx") + " select service, count(*) as n, count(distinct vehicle) as buses from resolved where route_ix is null and service is not null group by service")
def unknown_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that name no route: their fixes and distinct buses."""
    rows = lookups.resolve_service(fixture.fixes(spark, sf_dir), fixture.routes(spark), fixture.aliases(spark)).where("route_ix is null and service is not null")
    return rows.groupBy("service").agg(F.count("*").alias("n"), F.countDistinct("vehicle").alias("buses"))


@query(ON_ROAD + " select service as line, count(*) as buses from resolved where route_ix is null group by service")
def live_only_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are on the road and that the schedule does not have."""
    return on_road(spark, sf_dir).where("route_ix is null").groupBy(F.col("service").alias("line")).agg(F.count("*").alias("buses"))


@query(ON_ROAD + """, a as (select 1800000000 + 20 * (select max(event_id) // 40 from events) - t as age from latest), l as (select list_sort(list(age)) as s, count(*) as n from a)
  select n, s[least(n, cast(floor(n * 0.5) as bigint) + 1)] as p50, s[least(n, cast(floor(n * 0.9) as bigint) + 1)] as p90 from l""")
def age_p50_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of the vehicles' newest fixes at floor ranks. Equal ages are counted first, so that no array of all rows is built."""
    now = table(spark, sf_dir, "events").agg((F.lit(1800000000) + 20 * F.expr("max(event_id) div 40")).alias("now"))
    ages = fixture.latest(fixture.fixes(spark, sf_dir)).join(F.broadcast(now)).groupBy((F.col("now") - F.col("t")).alias("age")).agg(F.count("*").alias("c"))
    upto = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)  # a row an age in whole seconds
    ranked = ages.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy())})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("age")))
    return ranked.agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"))


@query(FX + """, e as (select vehicle, to_json({'id': vehicle, 'n': count(*), 'newest': max(t)}) as body from fx group by vehicle) select vehicle, sha256(body) as hash from e""")
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each document, by which a later publication tells what has changed."""
    return json_documents(spark, sf_dir).select("vehicle", F.sha2("body", 256).alias("hash"))


@query(FX + """, o as (select distinct vehicle, service from fx where event_id % 2 = 0 and service is not null), n as (select distinct vehicle, service from fx where event_id % 2 = 1 and t % 3 > 0 and service is not null)
  select * from o except select * from n""")
def stale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys written before that the present documents no longer have, and that are to be removed; here of two halves of the fixes."""
    fx = fixture.fixes(spark, sf_dir).where("service is not null")
    old, new = fx.where("event_id % 2 = 0"), fx.where("event_id % 2 = 1 and t % 3 > 0")
    return old.select("vehicle", "service").distinct().join(new.select("vehicle", "service"), ["vehicle", "service"], "left_anti")


@query(PREV + """ , m as (select event_id, heading, (degrees(atan2(x - lag(x) over w, y - lag(y) over w)) + 360) % 360 as bearing from good window w as (partition by vehicle order by t, event_id))
  select event_id, round(bearing, 3) as bearing, round(least((bearing - heading + 720) % 360, 360 - (bearing - heading + 720) % 360), 3) as apart from m""")
def bearing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bearing from the fix before, and how far it is from the heading that the vehicle reports (0 to 180)."""
    rows = hygiene.with_previous(fixture.good_fixes(fixture.fixes(spark, sf_dir)), ["vehicle"], ["t", "event_id"])
    b = geo.bearing(F.col("prev_x"), F.col("prev_y"), F.col("x"), F.col("y"))
    turn = F.pmod(b - F.col("heading"), F.lit(360.0))
    return rows.select("event_id", F.round(b, 3).alias("bearing"), F.round(F.when(turn > 180, 360 - turn).otherwise(turn), 3).alias("apart"))
