"""Queries on schedules: headways, calendars, representative trips, stop names, catalogues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vialens.functions import codes, times
from vialens.operators import schedule
from vialens.plans.registry import query, table

#: Windows of service from the orders: a customer's are those of one line; some are empty, without a headway, or go past midnight.
WINDOW_SQL = "concat('c', o_custkey) as line, cast(o_orderkey % 3 as int) as svc, cast(o_orderkey * 7919 % 86400 as int) as s, cast(o_orderkey * 7919 % 86400 + o_orderkey * 104729 % 30000 - 500 as int) as e, cast(o_orderkey % 25 * 60 as int) as h"
WINDOWS_SQL = f"f as (select {WINDOW_SQL} from orders)"
RATES_SQL = f"""with {WINDOWS_SQL}, x as (select line, svc, s, e, h, unnest(range(s // 3600, (e - 1) // 3600 + 1)) as hr from f where h > 0 and e > s),
rates as (select line, svc, cast(hr % 24 as int) as hour, sum(3600.0 / h * (least(e, (hr + 1) * 3600) - greatest(s, hr * 3600)) / 3600.0) as rate from x group by all),
mins as (select line, svc, hour, cast(case when rate > 0.05 then greatest(1, round(60.0 / rate)) end as int) as minutes from rates),
runs as (select line, svc, minutes, min(hour) as from_hour, max(hour) + 1 as to_hour from (select *, hour - row_number() over (partition by line, svc, minutes order by hour) as g from mins where minutes is not null) group by line, svc, minutes, g)"""


def hourly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of the orders' windows, added in the order of their keys, which is that of the table."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *re.split(r", (?=concat|cast)", WINDOW_SQL))
    return schedule.hourly_rates(rows.select("o_orderkey", "line", "svc", F.col("s").alias("start"), F.col("e").alias("end"), F.col("h").alias("headway")), ["o_orderkey"])


@query(RATES_SQL + " select line, svc, hour, round(rate, 6) as rate from rates")
def hourly_rate_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_rates(spark, sf_dir).select("line", "svc", "hour", F.round("rate", 6).alias("rate"))


@query(RATES_SQL + " select line, svc, cast(minutes as int) as minutes, cast(from_hour as int) as from_hour, cast(to_hour as int) as to_hour from runs")
def headway_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly_rates(spark, sf_dir).withColumn("minutes", schedule.headway_minutes(F.col("rate")))
    return schedule.runs(h).select("line", "svc", "minutes", "from_hour", "to_hour")


@query(RATES_SQL + """, d as (select 'g' || cast(substr(line, 2) as bigint) // 2 as line, svc, hour, min(minutes) as minutes from mins where minutes is not null group by all)
  select line, svc, cast(minutes as int) as minutes, cast(min(hour) as int) as from_hour, cast(max(hour) + 1 as int) as to_hour from (select *, hour - row_number() over (partition by line, svc, minutes order by hour) as g from d) group by line, svc, minutes, g""")
def best_headway(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least headway of a line over its shapes, as runs; here the lines of two neighbours count as shapes of one."""
    h = hourly_rates(spark, sf_dir).withColumn("minutes", schedule.headway_minutes(F.col("rate"))).where("minutes is not null")
    best = h.groupBy(F.concat(F.lit("g"), F.expr("cast(substr(line, 2) as bigint) div 2")).alias("line"), "svc", "hour").agg(F.min("minutes").alias("minutes"))
    return schedule.runs(best).select("line", "svc", "minutes", "from_hour", "to_hour")


CALENDAR = [("U_REG", "1", "1", "1", "1", "1", "0", "0", "19900101", "20301231"), ("S_REG", "0", "0", "0", "0", "0", "1", "0", "19900101", "20301231"), ("D_REG", "0", "0", "0", "0", "0", "0", "1", "19900101", "20301231"), ("OTHER", "1", "1", "1", "1", "1", "1", "1", "19900101", "20301231")]
EXCEPTIONS_SQL = "select distinct strftime(o_orderdate, '%Y%m%d') as date, case when month(o_orderdate) = 12 then 'D_REG' else 'U_REG' end as service_id, case when month(o_orderdate) = 12 then '1' else '2' end as exception_type from orders where day(o_orderdate) in (1, 25)"


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.dayofmonth("o_orderdate").isin(1, 25))
    dec = F.month("o_orderdate") == 12
    return o.select(F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.when(dec, "D_REG").otherwise("U_REG").alias("service_id"), F.when(dec, "1").otherwise("2").alias("exception_type")).distinct()


def _calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CALENDAR, ", ".join(f"{c} string" for c in ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date")))


@query(f"""with x as ({EXCEPTIONS_SQL}), d as (select date, exception_type, case when dayofweek(strptime(date, '%Y%m%d')) = 0 then 2 when dayofweek(strptime(date, '%Y%m%d')) = 6 then 1 else 0 end as usual from x)
  select date, cast(case when exception_type = '1' then 2 end as int) as svc from d where (exception_type = '1' and usual <> 2) or (exception_type = '2' and usual = 0)""")
def calendar_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with another service than their weekday's: added Sundays in December, working days taken out else."""
    return schedule.calendar_exceptions(_calendar(spark), _dates(spark, sf_dir))


@query("""with c as (select ['U_REG', 'S_REG', 'D_REG', 'OTHER'][s_suppkey % 4 + 1] as service_id, s_suppkey * 37 // 8 as bits from supplier),
  d as (select case substr(service_id, 1, 2) when 'U_' then 0 when 'S_' then 1 when 'D_' then 2 end as svc, weekday from c, range(7) w(weekday) where bits // cast(power(2, weekday) as bigint) % 2 = 1)
  select cast(weekday as int) as weekday, cast(min(svc) as int) as svc from d where svc is not null group by weekday""")
def weekday_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least service that runs on each weekday: suppliers as rows of a calendar, the bits of their keys as its days."""
    names = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
    k = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, ("U_REG", "S_REG", "D_REG", "OTHER"))), (k % 4).cast("int"))
    days = [F.expr(f"cast(s_suppkey * 37 div 8 div {1 << d} % 2 as string)").alias(n) for d, n in enumerate(names)]
    return schedule.weekday_services(table(spark, sf_dir, "supplier").select(kind.alias("service_id"), *days))


@query(f"""with x as ({EXCEPTIONS_SQL}), o as (select o_orderkey, strftime(o_orderdate, '%Y%m%d') as date, dayofweek(o_orderdate) as wd from orders)
  select svc, count(*) as n from (select case when x.exception_type = '1' then 2 when x.exception_type = '2' and wd between 1 and 5 then null when wd = 0 then 2 when wd = 6 then 1 else 0 end as svc from o left join x using (date)) group by svc""")
def day_type_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The service of each order's date: its exception, else its weekday's."""
    ex = schedule.calendar_exceptions(_calendar(spark), _dates(spark, sf_dir)).withColumn("hit", F.lit(True)).withColumnRenamed("svc", "other")
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("date"), times.weekday(F.col("o_orderdate")).alias("weekday"))
    rows = o.join(ex, "date", "left").join(F.broadcast(schedule.weekday_services(_calendar(spark))), "weekday", "left")
    return rows.groupBy(F.when(F.col("hit"), F.col("other")).otherwise(F.col("svc")).alias("svc")).agg(F.count("*").alias("n"))


@query("select o_custkey, o_orderkey, n from (select o_custkey, o_orderkey, n, row_number() over (partition by o_custkey order by n desc, o_orderkey desc) as rn from (select o_custkey, o_orderkey, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by all)) where rn = 1")
def representative_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member of each group with the most rows, the last of equals: orders as trips, customers as shapes."""
    trips = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shape_id"), F.col("o_orderkey").alias("trip_id"))
    rows = schedule.representative_trips(trips, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id")))
    return rows.select(F.col("shape_id").alias("o_custkey"), F.col("trip_id").alias("o_orderkey"), "n")


@query("select l_orderkey, l_linenumber, l_returnflag from (select *, lag(l_returnflag) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as p from lineitem) where p is null or p <> l_returnflag")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lag("l_returnflag").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").withColumn("p", p).where("p is null or p <> l_returnflag").select("l_orderkey", "l_linenumber", "l_returnflag")


@query("select l_orderkey, l_linenumber, l_partkey, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding), 3) as cum from lineitem")
def cumulative_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.sum("l_quantity").over(w), 3).alias("cum"))


RAW_STOPS = "concat(case p_partkey % 6 when 0 then 'BRS 1, 2: ' when 1 then 'Ponto Final: ' when 2 then 'Ponto Regulador:' when 3 then 'BRS' when 4 then ' ' else 'BRS : ' end, p_name, case when p_partkey % 5 = 0 then ' :: side B' else '' end)"


@query(f"""with r as (select p_partkey, p_name as nm, trim({RAW_STOPS}) as raw, p_partkey % 6 as k, p_partkey % 5 = 0 as c from part)
  select p_partkey, case k when 0 then nm when 1 then nm when 2 then nm else trim(case when c then substr(raw, 1, instr(raw, '::') - 1) else raw end) end as name,
  concat_ws(' · ', case k when 0 then 'BRS 1, 2' when 1 then 'Ponto final' when 2 then 'Ponto regulador' end, case when c then 'side B' end) as note from r""")
def stop_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(RAW_STOPS)
    return table(spark, sf_dir, "part").select("p_partkey", codes.stop_name(raw).alias("name"), codes.stop_note(raw).alias("note"))


@query("select s_suppkey, regexp_replace(s_name || ' é/' || s_suppkey, '[^A-Za-z0-9\\-_.]', '_', 'g') as name from supplier")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", codes.sanitize(F.concat("s_name", F.lit(" é/"), "s_suppkey")).alias("name"))


@query("with h as (select p_partkey, case when p_partkey % 4 = 0 then 'zz' || p_partkey else lower(lpad(to_hex(p_partkey * 7919 % 16777216), 6, '0')) end as c from part) select p_partkey, case when regexp_matches(c, '^[0-9A-Fa-f]{6}$') then '#' || upper(c) else '' end as color from h")
def hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("case when p_partkey % 4 = 0 then concat('zz', p_partkey) else lower(lpad(hex(p_partkey * 7919 % 16777216), 6, '0')) end")
    return table(spark, sf_dir, "part").select("p_partkey", codes.hex_color(c).alias("color"))


STOPS_SQL = "k as (select distinct concat('s', l_suppkey) as stop_id, o_custkey, n_nationkey, n_name, l_quantity as q from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)"


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops and the lines that serve them: suppliers of the orders of each nation's customers."""
    home = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("s"), "l_suppkey").alias("stop_id"), F.col("l_quantity").alias("q"))
    rows = held.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(home, "o_custkey")
    return rows.select("stop_id", "o_custkey", "n_nationkey", "q").distinct().join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query(f"with {STOPS_SQL} select stop_id, string_agg(distinct n_name, ',' order by n_name) as lines, count(distinct o_custkey) as shapes from k group by stop_id")
def stop_lines_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each stop, and by how many shapes they come there."""
    return _served(spark, sf_dir).groupBy("stop_id").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("lines"), F.countDistinct("o_custkey").alias("shapes"))


@query(f"""with {STOPS_SQL}, n as (select *, case when n_nationkey % 3 = 0 then 'LECD' || n_nationkey else n_name end as line, 'to ' || o_custkey % 3 as towards from k)
  select line, string_agg(distinct towards, ',' order by towards) as ends, cast(max(q) as double) as length, starts_with(line, 'LECD') as provisional from n group by line""")
def line_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's directions, length and whether its name is provisional."""
    line = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("LECD"), "n_nationkey")).otherwise(F.col("n_name"))
    out = _served(spark, sf_dir).groupBy(line.alias("line")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("to "), F.col("o_custkey") % 3))), ",").alias("ends"), F.max("q").cast("double").alias("length"))
    return out.withColumn("provisional", codes.is_provisional(F.col("line")))


@query("""with p as (select l_orderkey as shape_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as i, cast(l_partkey * 13 % 700 as double) as x, cast(l_suppkey * 7 % 500 as double) as y from lineitem),
  c as (select *, 100.0::double * (i - 1) as cum from p), e as (select shape_id, first(x order by i) as ax, first(y order by i) as ay, last(x order by i) as bx, last(y order by i) as by_ from p group by shape_id)
  select shape_id, max(cum) as length, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, bool_or(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) < 300) as circular from c join e using (shape_id) group by shape_id""")
def gtfs_shape_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, bounds and whether it closes of each shape: orders as shapes, their lines as points."""
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("shape_id"), i.alias("i"), (F.col("l_partkey") * 13 % 700).cast("double").alias("x"), (F.col("l_suppkey") * 7 % 500).cast("double").alias("y"))
    return schedule.shape_facts(points.withColumn("cum", 100.0 * (F.col("i") - 1))).select("shape_id", "length", "x0", "x1", "y0", "y1", "circular")
