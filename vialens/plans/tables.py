"""Queries with windows, folds and set operations on the plain tables and the fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import folds
from vialens.plans import fixture
from vialens.plans.fixture import FX, LATEST_SQL
from vialens.plans.registry import query, table
from vialens.sources import feeds

GOOD = LATEST_SQL.split("latest as")[0].rstrip().rstrip(",")


@query("select time_bucket(interval 10 minutes, ts, timestamp '1970-01-01') as start, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("with b as (select time_bucket(interval 5 minutes, ts, timestamp '1970-01-01') as s, value from events), x as (select s - interval (5 * k) minutes as start, value from b, range(3) t(k)) select start, count(*) as n from x group by start")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "15 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "n")


@query("""with g as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hours then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
  s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, max(ts) + interval 6 hours as end_, count(*) as n from s group by user_id, k""")
def session_gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user that a silence of six hours ends."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end_"), "n")


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vehicle's fixes of an hour as an array in order: at most some thousand fixes."""
    good = fixture.good_fixes(fixture.fixes(spark, sf_dir))
    return good.groupBy("vehicle", F.expr("t div 3600").alias("hour")).agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "x", "y"))).alias("f"))


HOUR_SQL = "with recursive " + FX.removeprefix("with ") + "," + GOOD + ", o as (select vehicle, t // 3600 as hour, t, x, y, row_number() over (partition by vehicle, t // 3600 order by t, event_id) as k from good)"


@query(HOUR_SQL + """, f(vehicle, hour, k, t, x, y, v) as (select vehicle, hour, k, t, x, y, cast(0 as double) from o where k = 1 union all
  select o.vehicle, o.hour, o.k, case when o.t - f.t >= 10 then o.t else f.t end, case when o.t - f.t >= 10 then o.x else f.x end, case when o.t - f.t >= 10 then o.y else f.y end,
  case when o.t - f.t >= 10 then f.v + (1 - power(0.5, (o.t - f.t) / 60.0)) * (least(sqrt(power(o.x - f.x, 2) + power(o.y - f.y, 2)) / (o.t - f.t), 27.0) - f.v) else f.v end from f join o on o.vehicle = f.vehicle and o.hour = f.hour and o.k = f.k + 1)
  select vehicle, hour, round(last(v order by k), 4) as speed, count(*) as n from f group by vehicle, hour""")
def ewma_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vehicle's smoothed speed at the end of each hour, started anew each hour."""
    return _hours(spark, sf_dir).select("vehicle", "hour", F.round(folds.ewma_speed(F.col("f")), 4).alias("speed"), F.size("f").cast("long").alias("n"))


@query(HOUR_SQL + """, f(vehicle, hour, k, t, x, y) as (select vehicle, hour, k, t, x, y from o where k = 1 union all
  select o.vehicle, o.hour, o.k, case when sqrt(power(o.x - f.x, 2) + power(o.y - f.y, 2)) > 100 then o.t else f.t end, case when sqrt(power(o.x - f.x, 2) + power(o.y - f.y, 2)) > 100 then o.x else f.x end,
  case when sqrt(power(o.x - f.x, 2) + power(o.y - f.y, 2)) > 100 then o.y else f.y end from f join o on o.vehicle = f.vehicle and o.hour = f.hour and o.k = f.k + 1)
  select vehicle, hour, last(t order by k) as moved from f group by vehicle, hour""")
def moved_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir).select("vehicle", "hour", folds.last_moved(F.col("f")).alias("moved"))


@query("""with recursive m as (select date_trunc('minute', ts) as minute, count(*) as n from events group by 1), o as (select date_trunc('day', minute) as day, n, row_number() over (partition by date_trunc('day', minute) order by minute) as k from m),
  f(day, k, v) as (select day, cast(0 as bigint), cast(4000 as double) from (select distinct day from o) union all select o.day, o.k, case when o.n >= 2 then 0.8 * f.v + 0.2 * o.n else f.v end from f join o on o.day = f.day and o.k = f.k + 1)
  select day, round(last(v order by k), 4) as typical from f group by day""")
def typical_rows_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smoothed rows of a complete minute at the end of each day; minutes with under two rows are stubs."""
    m = table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n"))
    d = m.groupBy(F.date_trunc("day", "minute").alias("day")).agg(F.array_sort(F.collect_list(F.struct("minute", F.col("n").cast("double").alias("rows"), (F.col("n") >= 2).alias("complete")))).alias("b"))
    return d.select("day", F.round(folds.typical_rows(F.col("b")), 4).alias("typical"))


KEPT_SQL = """, g(service, k, kept) as (select distinct service, cast(0 as bigint), cast([] as struct(id bigint, x double, y double)[]) from p union all
  select p.service, p.k, case when len(list_filter(g.kept, lambda c: sqrt(power(c.x - p.x, 2) + power(c.y - p.y, 2)) < {metres})) > 0 then g.kept else list_append(g.kept, {{'id': p.id, 'x': p.x, 'y': p.y}}) end from g join p on p.service = g.service and p.k = g.k + 1),
  z as (select service, unnest(last(kept order by k)) as c from g group by service) """


@query("with recursive " + FX.removeprefix("with ") + "," + LATEST_SQL + ", p as (select service, event_id as id, x, y, row_number() over (partition by service order by event_id) as k from latest)" + KEPT_SQL.format(metres=1000) + "select service, c.id as id, round(c.x, 3) as x, round(c.y, 3) as y from z")
def greedy_place_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each line's newest places, those not within 1,000 m of one kept before."""
    rows = fixture.latest(fixture.fixes(spark, sf_dir)).groupBy("service").agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), "x", "y"))).alias("p"))
    return rows.select("service", F.explode(folds.keep_apart(F.col("p"), 1000.0)).alias("k")).select("service", "k.id", F.round("k.x", 3).alias("x"), F.round("k.y", 3).alias("y"))


@query("""with recursive p as (select *, row_number() over (partition by service order by id) as k from (select lower(p_name) as service, p_partkey as id, cast(p_partkey * 7 % 1500 as double) as x, cast(p_partkey * 11 % 900 as double) as y from part))""" + KEPT_SQL.format(metres=600) + "select service as name, c.id as id from z")
def one_per_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found places without those that have the name, case aside, of one kept before within 600 m; a name's places fit in an array."""
    place = F.struct(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 1500).cast("double").alias("x"), (F.col("p_partkey") * 11 % 900).cast("double").alias("y"))
    rows = table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name")).agg(F.array_sort(F.collect_list(place)).alias("p"))
    return rows.select("name", F.explode(folds.keep_apart(F.col("p"), 600.0)).alias("k")).select("name", "k.id")


@query(FX + "," + GOOD + """, g as (select vehicle, t // 3600 as hour, row_number() over (partition by vehicle, t // 3600 order by t, event_id, lat, lon) as i, cast(round_even(lat * 100000, 0) as bigint) as a, cast(round_even(lon * 100000, 0) as bigint) as o from good),
  d as (select vehicle, hour, i, a - lag(a, 1, 0) over w as da, o - lag(o, 1, 0) over w as do_ from g window w as (partition by vehicle, hour order by i)),
  v as (select vehicle, hour, i, unnest([1, 2]) as k, unnest([if(da < 0, -2 * da - 1, 2 * da), if(do_ < 0, -2 * do_ - 1, 2 * do_)]) as v from d),
  c as (select *, unnest(list_filter(range(0, 8), lambda j: j = 0 or v >= (1::bigint << (5 * j)::int))) as j from v),
  x as (select vehicle, hour, string_agg(chr(cast(63 + (v >> (5 * j)::int) % 32 + if(v >= (1::bigint << (5 * j + 5)::int), 32, 0) as int)), '' order by i, k, j) as line from c group by all)
  select vehicle, hour, count(*) as n, md5(any_value(line)) as digest, any_value(length(line)) as length from g join x using (vehicle, hour) group by all""")
def polyline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vehicle's hour as an encoded polyline, decoded and encoded again: the digest and length of its text."""
    good = fixture.good_fixes(fixture.fixes(spark, sf_dir))
    rows = good.groupBy("vehicle", F.expr("t div 3600").alias("hour")).agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "lat", "lon"))).alias("f"))
    once = rows.withColumn("line", folds.encode_polyline(F.flatten(F.transform("f", lambda f: F.array(f["lat"], f["lon"])))))
    again = once.withColumn("line", folds.encode_polyline(folds.decode_polyline("line")))
    return again.select("vehicle", "hour", F.size("f").cast("long").alias("n"), F.md5("line").alias("digest"), F.length("line").cast("long").alias("length"))


@query("select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def used_shapes_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("select n_name, coalesce(n, 0) as suppliers, coalesce(top, '') as top from nation left join (select s_nationkey, count(*) as n, string_agg(s_name, ',' order by s_name) filter (where rn <= 3) as top from (select *, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier) group by s_nationkey) on s_nationkey = n_nationkey")
def dense_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation with its count of suppliers and the three with the largest balance."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    s = table(spark, sf_dir, "supplier")
    top = s.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("top"))
    n = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers")).join(top, "s_nationkey")
    j = table(spark, sf_dir, "nation").join(F.broadcast(n), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return j.select("n_name", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("top", F.lit("")).alias("top"))


@query("select event_id, event_type, cast(props->>'k' as bigint) as k from events")
def json_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


INGEST_SQL = FX + """, w as (select event_id, vehicle, vendor, t, seen_at, lat, lon, service, heading, sentido from fx where event_id % 13 <> 0 and event_id % 17 <> 0)"""


@query(INGEST_SQL + " select vehicle, vendor, t, round(lat, 6) as lat, round(lon, 6) as lon, case when heading > 0 and heading <= 360 then heading end as heading, service, sentido as dir, event_id % 5 = 0 or vendor = 'sonda' as brt from w")
def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes written as pages of the aggregator's JSON and parsed back: rows without id or place go, blanks become null."""
    fx = fixture.fixes(spark, sf_dir)
    row = F.struct(
        F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("vehicle")).alias("id_veiculo"), F.initcap("vendor").alias("fornecedor"), F.when(F.col("event_id") % 5 == 0, "BRT").otherwise("onibus").alias("modo"), F.coalesce("service", F.lit("")).alias("servico"),
        F.upper(F.coalesce("sentido", F.lit(""))).alias("sentido"), F.when(F.col("event_id") % 17 != 0, F.round("lat", 6)).alias("latitude"), F.round("lon", 6).alias("longitude"), F.coalesce("heading", F.lit(0.0)).alias("direcao"),
        F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.date_format(F.timestamp_seconds("seen_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime_servidor"),
    )
    page = fx.groupBy(F.expr("event_id div 500").alias("page")).agg(F.to_json(F.struct(F.lit("2027-01-15T08:00:00Z").alias("minuto_utc"), F.collect_list(row).alias("data"))).alias("value"))
    rows = feeds.fixes_of_pages(page.select("value"))
    return rows.select("vehicle", "vendor", "t", "lat", "lon", "heading", "service", "dir", "brt")


@query(FX + """, p as (select vendor, event_id // 500 as page, last(case when value < 30 then 'late' when value < 60 then 'ok' else event_id::varchar end order by event_id) as status from fx join events using (event_id) where event_id % 7 <> 0 or vendor <> 'sonda' group by all)
  select vendor as provider, last(status order by page) as status from p group by vendor""")
def provider_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each provider as the feed's pages in order state it: the last page that names one wins."""
    fx = fixture.fixes(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id").where("event_id % 7 <> 0 or vendor <> 'sonda'")
    said = F.when(F.col("value") < 30, "late").when(F.col("value") < 60, "ok").otherwise(F.col("event_id").cast("string"))
    last = fx.groupBy(F.expr("event_id div 500").alias("page"), "vendor").agg(F.max_by(said, "event_id").alias("status"))
    pages = last.groupBy("page").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("vendor", "status"))).alias("providers_status"))).alias("value"))
    return feeds.provider_status(pages)
